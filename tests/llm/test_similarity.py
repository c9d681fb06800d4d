"""Verified near-duplicates against brute-force Jaccard similarities."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from kinweave.llm import similarity
from tests.llm import brute


def shingles(text, size=5):
    w = brute.WORD.findall(brute.lower(text))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(docs):
    """Component of each row of (id, text), by place, as its least place."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def edited(n_bases=40, seed=3):
    """Texts and versions of them with words changed, at similarities on both sides of 0.8."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        out.append(" ".join(words))
        for n in (3, 4, 5, 6):
            version = list(words)
            for i in rng.sample(range(len(words)), n):
                version[i] = f"x{rng.randrange(10**9)}"
            out.append(" ".join(version))
    rng.shuffle(out)
    return list(enumerate([*out, None, "", " ", "one", "one", "One two"]))


@pytest.mark.parametrize("block_shingles", [300, 1 << 19])
def test_links_are_those_of_the_similarity(spark, block_shingles):
    """No component holds texts that links at the similarity don't join; of pairs that link nearly all share a component, and all of a wide enough radius."""
    docs = edited()
    frame, want = spark.createDataFrame(docs, "doc_id long, text string"), components(docs)
    sets = [shingles(t) for _, t in docs]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a & b and alike(a, b)]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.8 <= s < 0.87 for s in shares) > 20 and sum(0.73 < s < 0.8 for s in shares) > 20
    got = {r["doc_id"]: r["component_id"] for r in similarity.similar_documents(frame, block_shingles=block_shingles).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    got = similarity.similar_documents(frame, tau=48, block_shingles=block_shingles).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: want[i] for i, _ in docs}


def test_stage_on_documents(spark):
    """The pipeline's stage on the 0.01 tables keeps one document of each component, that of the least id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = Counter(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect())
    assert kept == Counter(rows[k][0] for k in set(components(rows)))


def test_recall_of_fingerprints():
    """Of sets at a similarity of exactly 0.8, 110 to 1,100 shingles in both together, at least nine in ten are candidates, and more above it."""
    rng = np.random.default_rng(1)
    near = lambda a, b: [sum((p ^ q).bit_count() for p, q in zip(x, y)) <= similarity.TAU for x, y in zip(a, b)]
    prints = lambda sets: [tuple(map(int, p)) for p in zip(*similarity.set_prints(sets))]
    for unit in (10, 100):
        drawn = [rng.integers(0, 1 << 63, 11 * unit, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 11 * unit, dtype=np.uint64) for _ in range(1000)]
        for cut, share in ((unit + unit // 10, 0.9), (unit // 2, 0.99)):
            assert sum(near(prints([x[: len(x) - cut] for x in drawn]), prints([x[cut:] for x in drawn]))) >= share * len(drawn)


def test_a_row_of_each_component(spark):
    """Unrelated texts under a null or a repeated id all stay; copies go, also those under an id that names another component."""
    texts = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(9)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " more"), (7, texts[3]), (7, texts[4]), (7, texts[4] + " more"), (7, texts[4]), (1, texts[5]), (7, texts[5]), (None, texts[5]), (9, texts[0] + " more"), (None, None), (8, None), (8, "")]
    docs = spark.createDataFrame([(*d, k) for k, d in enumerate(data)], "doc_id long, text string, key int")
    got = similarity.keep_first(docs).collect()
    want = [(9, texts[0] + " more"), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (1, texts[5]), (8, "")]
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == sorted(w for w in want if w[0])
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted(w[1] for w in want if w[0] is None)
    assert all(data[r["key"]] == (r["doc_id"], r["text"]) for r in got)
