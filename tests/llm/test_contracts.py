"""Every query against a brute-force version of its contract, over whole tables with odd rows."""

import math
import random
from collections import Counter

import pytest

from kinweave.llm import dealing, sentences
from kinweave.llm import queries as q
from tests.llm import brute


def by_id(df, *names):
    rows = df.collect()
    out = {r["doc_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_sentences(spark, sample, sample_dir):
    want = brute.sentences([r[:2] for r in sample])
    assert any(w[1] for w in want.values())
    assert by_id(q.op1_sentence_dedup(spark, sample_dir), "n_sentences", "n_removed", "kept_sha256") == want


def test_tokens(spark, sample, sample_dir):
    from tokenizers import Tokenizer

    got = by_id(q.op2_token_binary(spark, sample_dir), "start", "n_tokens", "ids_crc32")
    assert got == brute.tokens([r[:2] for r in sample], Tokenizer.from_file(q.tokenizer_path()))


def test_language(spark, sample, sample_dir):
    got = by_id(q.op3_language_id(spark, sample_dir), "held_out", "lang_pred", "score")
    for i, text, *_ in sample:
        assert got[i][0] == (brute.crc(i) % 4 == 2)
        assert (got[i][1] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= got[i][2] <= 1
    judged = [(lang, got[i][1]) for i, t, lang, _ in sample[:200] if got[i][0] and lang and len(t.split()) > 20]
    assert judged and sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_marginals():
    """Chunked forward-backward against sums over all labellings, and a long sequence against a plain loop."""
    import itertools

    import numpy as np

    from kinweave.llm.language import marginals

    rng = np.random.default_rng(1)
    move = rng.normal(size=(3, 3))
    emissions = rng.random((5, 3)).astype(np.float32)
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        start = np.exp(move)[:, path[0]].sum()
        want[range(5), path] += start * np.prod([emissions[t, y] for t, y in enumerate(path)]) * np.prod([np.exp(move[a, b]) for a, b in zip(path, path[1:])])
    assert marginals(emissions, np.array([0, 0, 5, 5]), move) == pytest.approx(want / want.sum(1, keepdims=True), rel=1e-4)
    emissions = rng.random((333, 3)).astype(np.float32)
    forward, backward = np.empty((333, 3)), np.ones((333, 3))
    a = np.full(3, 1 / 3)
    for t in range(333):
        a = (a @ np.exp(move)) * emissions[t]
        forward[t] = a = a / a.sum()
    for t in range(331, -1, -1):
        backward[t] = np.exp(move) @ (emissions[t + 1] * backward[t + 1])
        backward[t] /= backward[t].sum()
    want = forward * backward
    assert marginals(emissions, np.array([0, 333]), move) == pytest.approx(want / want.sum(1, keepdims=True), rel=1e-3)


def test_quality(spark, sample, sample_dir):
    names = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    got = q.op4_quality_rules(spark, sample_dir)
    assert by_id(got, *names) == {r[0]: brute.quality(r[1]) for r in sample}
    assert not got.where("kept and base_failed").count()


def test_rules_run_once_unless_reasons_are_asked_for(spark, monkeypatch):
    """Without reasons a rejected text's rules aren't run again; with them the first given rule that rejects it is named."""
    docs = spark.createDataFrame([(1, "#### " * 80), (2, None), (3, "word " * 10)], "doc_id long, text string")
    assert "rejected_by" not in q.quality.quality_report(docs).columns
    got = {r["doc_id"]: (r["kept"], r["rejected_by"]) for r in q.quality.quality_report(docs, reasons=True).collect()}
    given = q.quality.default_rules()
    assert got == {i: (False, q.quality.first_rejection(q.quality.Page((t or "").encode() if t is not None else None), given)) for i, t in ((1, "#### " * 80), (2, None), (3, "word " * 10))}


def test_substrings(spark, sample, sample_dir):
    got = by_id(q.op5_substring_dedup(spark, sample_dir), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.substrings([r[:2] for r in sample])
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_pii(spark, sample, sample_dir):
    names = "n_email", "n_ip", "n_card", "n_phone", "base_sha256"
    got, want = by_id(q.op6_pii(spark, sample_dir), *names), {r[0]: brute.pii(r[1]) for r in sample}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_decontaminate(spark, sample, sample_dir):
    names = "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    items = [tuple(r) for r in spark.read.parquet(f"{sample_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.decontaminate([r[:2] for r in sample], items)
    assert any(w[1] for w in want.values())
    assert by_id(q.op7_decontaminate(spark, sample_dir), *names) == want


def test_mixing(spark, sample, sample_dir):
    got = q.mixing.mix(spark.read.parquet(f"{sample_dir}/documents.parquet")).collect()
    sizes = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in sample}
    per, target = brute.mix_targets([(r[3], sizes[r[0]]) for r in sample])
    taken, largest = dict.fromkeys(per, 0), dict.fromkeys(per, 0)
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[r["source"]] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(sample)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in per)


def test_simhash(spark, sample, sample_dir):
    got = by_id(q.op8_simhash(spark, sample_dir), "fingerprint", "component_id")
    want = brute.simhash([r[:2] for r in sample])
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def brute_bigrams(docs, discount=0.75):
    """The same model with plain counts."""
    pairs, train = Counter(), [t for i, t in docs if brute.crc(i) % 5 != 1]
    tokens = lambda t: [*brute.WORD.findall(brute.lower(t)), None]
    for t in train:
        pairs.update(zip([0, *tokens(t)], tokens(t)))
    context, after, single = Counter(), Counter(), Counter()
    for (v, w), c in pairs.items():
        context[v] += c
        after[v] += 1
        single[w] += c
    n, kinds = sum(single.values()), len(single)
    out = {}
    for i, t in docs:
        total = 0.0
        for v, w in zip([0, *tokens(t)], tokens(t)):
            p = (single[w] + 0.5) / (n + 0.5 * (kinds + 1))
            total += math.log10(max(pairs[v, w] - discount, 0) / context[v] + discount * after[v] / context[v] * p if context[v] else p)
        out[i] = total
    return out


def test_lm(spark, sample, sample_dir):
    got = by_id(q.op10_lm_score(spark, sample_dir), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = [r[:2] for r in sample]
    want, scores = brute.base_scores(docs), brute_bigrams(docs)
    assert {i: g[:4] for i, g in got.items()} == {i: w[:4] for i, w in want.items()}
    for i, g in got.items():
        assert g[4] == pytest.approx(want[i][4], rel=1e-9)
        # A word's probability is the sum of two parts, each quantised within half a step of its logarithm.
        assert abs(g[5] - scores[i]) <= 1.01 * q.ngrams.STEP / 2 * g[1]


def test_lm_split_contexts(spark, sample_dir, monkeypatch):
    """Splitting contexts changes no score."""
    plain = by_id(q.op10_lm_score(spark, sample_dir), "score")
    monkeypatch.setattr(q.ngrams, "HOT_PARTS", 40)
    split = by_id(q.op10_lm_score(spark, sample_dir), "score")
    assert all(split[i][0] == pytest.approx(plain[i][0], rel=2e-4) for i in plain)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty(spark, empty_dir, name):
    assert q.queries()[name](spark, empty_dir).collect() == []


def test_sentences_catch_planted_passages(spark):
    """Passages of over 50 words that begin and end within sentences, and within text without punctuation."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    prose = lambda n, ends: " ".join(word() + (rng.choice(ends) if rng.random() < 0.12 else "") for _ in range(n))
    docs, later = [], set()
    for k in range(60):
        ends = [".", "! ", ",", ";"] if k % 3 else [""]
        passage = prose(55, ends) if k % 6 else " ".join([word()] * 55)
        for copy in range(2):
            i = 2 * k + copy
            later |= {i} if copy else set()
            docs.append((i, f"{prose(rng.randrange(5, 80), ends)} {passage} {prose(rng.randrange(5, 80), ends)}"))
    docs += [(1000 + i, prose(200, [".", ","])) for i in range(60)]
    got = {r["doc_id"]: r["n_removed"] for r in sentences.dedup_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    punctuated = {i for i in later if (i // 2) % 3}
    assert sum(got[i] > 0 for i in punctuated) >= 0.95 * len(punctuated)
    # A passage of one word repeats within its own document too.
    assert not any(got[i] for i, _ in docs if i not in later and (i >= 1000 or (i // 2) % 6))


def test_dealing_splits_a_hot_id(spark):
    """Rows of one id are split by text; buckets follow the order of id and text, and those of one id share their order."""
    data = [(7, f"{k:05d} text") for k in range(4000)] + [(i, "x" * 30) for i in range(100) if i != 7] + [(None, f"{k:05d} none") for k in range(3000)]
    dealt = dealing.deal(spark.createDataFrame(data, "doc_id long, text string"), 4000)
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["bucket"]) for r in dealt.rows.collect())
    buckets = [r[3] for r in rows]
    assert buckets == sorted(buckets) and len(rows) == len(data)
    sizes = {b: buckets.count(b) for b in set(buckets)}
    assert max(sizes.values()) < 1000 and dealt.n_buckets > max(buckets)
    for missing, i, _, b in rows:
        others = {r[3] for r in rows if r[:2] != (missing, i)}
        if len({r[3] for r in rows if r[:2] == (missing, i)}) > 1:
            assert b not in others
    order = dealt.order[[r[3] for r in rows]]
    assert len(set(order[[k for k, r in enumerate(rows) if r[1] == 7]])) == len(set(order[[k for k, r in enumerate(rows) if r[0]]])) == 1
