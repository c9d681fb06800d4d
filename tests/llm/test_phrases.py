"""Phrases against plain counting, with words of one language hot, split batches and bytes below the separator."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import phrases
from tests.llm import brute

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r[n] for n in NAMES) for r in phrases.mine_phrases(docs, **options).collect())


def prose(seed, n, vocabulary=12, languages=("en", "de", None)):
    """Texts of few words, the first of them in every third place, with all cuts and some rare bytes."""
    rng = random.Random(seed)
    words = ["the", *(f"W{k}" for k in range(vocabulary)), "a\x01", "a\x01b", "a", "\x00", "é", "wż"]
    cuts = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", "!"]
    return [(rng.choice(languages), "".join((words[0] if rng.random() < 0.33 else rng.choice(words)) + rng.choice(cuts) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_counting(spark, seed):
    rows = prose(seed, 120) + [(None, None), ("en", ""), ("und", "w1 w2 w1 w2 w1 w2 " * 4), ("en", "the the the the the the the " * 20)]
    want = sorted(brute.phrases(rows, min_count=4))
    assert mined(spark, rows, min_count=4) == want and len(want) > 100
    assert mined(spark, rows, min_count=4, top=7) == [r for r in want if r[1] <= 7]
    assert mined(spark, rows, min_count=3, max_n=3) == sorted(brute.phrases(rows, max_n=3, min_count=3))


def test_blocks_and_rare_words(spark, monkeypatch):
    """Small blocks, and maps that prune nothing, change nothing."""
    rows = prose(5, 60, vocabulary=40)
    want = sorted(brute.phrases(rows, min_count=3))
    monkeypatch.setattr(phrases, "_BLOCK_BYTES", 300)
    assert mined(spark, rows, min_count=3) == want
    # With all bits set nothing is pruned.
    monkeypatch.setattr(phrases, "run_map", lambda packed, min_count: np.full(phrases.RUN_BITS // 8, 255, np.uint8))
    assert mined(spark, rows, min_count=3) == want


def test_packed_counts():
    places, counts = np.array([0, 1, 700, 32767]), np.array([1, 255, 256, 100_000])
    sums = np.zeros(32768, np.int64)
    np.add.at(sums, *phrases._unpacked(phrases._packed(places, counts)))
    assert sums[places].tolist() == counts.tolist() and sums.sum() == counts.sum()


def test_stack_across_batches():
    """Sorted suffixes cut into batches anywhere give the same counts; short prefixes of hot words are told whatever they count."""
    rng = random.Random(3)
    suffixes = sorted({("en" if rng.random() < 0.5 else "de", b"\t".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 5)))) for _ in range(150)}, reverse=True)
    counts = [rng.randrange(1, 4) for _ in suffixes]
    want = {}
    for (lang, s), n in zip(suffixes, counts):
        words = s.split(b"\t")
        for k in range(1, len(words) + 1):
            key = lang, b" ".join(words[:k]).decode()
            want[key] = want.get(key, 0) + n
    hot = phrases._hot_words(pa.array([b"a", b"b"], pa.large_binary()), "en", np.empty(0, np.int64))
    assert not hot.any()
    salt = phrases.combine(np.array([phrases.hash_text(b"en")], np.uint64), np.array([phrases.hash_text(b"a")], np.uint64)).view(np.int64)
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([s[0].encode() + b"\t" + s[1] for s in suffixes[k : k + size]], pa.binary()), pa.array(counts[k : k + size], pa.int64())], ["suffix", "n"]) for k in range(0, len(suffixes), size)]
        got = {(r["lang"], r["phrase"]): r["n"] for b in phrases._count(iter(batches), salt, 4, 5) for r in b.to_pylist()}
        assert got == {k: n for k, n in want.items() if n >= 5 or (k[0] == "en" and set(k[1].split()) == {"a"} and len(k[1].split()) < 4)}


def test_scores_beyond_64_bits(spark):
    """The product 1000 * a * n passes 2^63 while the score is exact."""
    from pyspark.sql import functions as F

    a, n, l, r = 10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 11
    wide = {k: F.lit(v).cast("decimal(17,0)") for k, v in dict(da=a, dn=n, dl=l, dr=r).items()}
    got = spark.range(1).select(*(c.alias(k) for k, c in wide.items())).selectExpr("(CAST(1000 AS DECIMAL(4,0)) * da * dn) div (dl * dr) AS score").first()[0]
    assert got == 1000 * a * n // (l * r)
