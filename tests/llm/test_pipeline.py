"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline as cp
from kinweave.llm import mixing, quality
from tests.llm import brute
from tests.llm.test_similarity import components


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sample_dir)
        before, after = docs.collect(), out.collect()
        if name == "token_output":
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(cp.tokenizer_path())
            start, want = 0, []
            for r in sorted(before, key=lambda r: (r["doc_id"], r["text"])):
                ids = tok.encode(r["text"], add_special_tokens=False).ids + [2]
                want.append((r["doc_id"], start, len(ids)))
                start += len(ids)
            assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in after) == want
            break
        assert out.schema == docs.schema
        given, kept = Counter(map(tuple, before)), Counter(map(tuple, after))
        assert set(kept) <= set(given)
        ids = Counter(r["doc_id"] for r in after)
        if name == "quality_rules":
            rules = quality.default_rules()
            assert set(ids) == {r["doc_id"] for r in before if not any(x.rejects(quality.Page((r["text"] or "").encode())) for x in rules)}
        elif name == "near_dedup":
            # The contract's similarity; fingerprints alone also linked texts below it.
            rows_before = sorted((r["doc_id"], r["text"]) for r in before)
            assert ids == Counter(rows_before[k][0] for k in set(components(rows_before)))
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sample_dir}/benchmark.parquet").select("item_id", "text").collect()]
            want = brute.decontaminate([(r["doc_id"], r["text"]) for r in before], items)
            assert ids == Counter(i for i, w in want.items() if not w[4])
        else:
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert ids == Counter({i: n for i, n in want.items() if n})
        assert after
        docs = spark.createDataFrame(after, docs.schema)


def test_run(spark, sample_dir, empty_dir):
    found = cp.run(spark, sample_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count()
    assert cp.run(spark, empty_dir).collect() == []


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows and ids, and columns named like inner ones go through every stage."""
    text = " ".join(f"word{i} of text" for i in range(60))
    data = [(None, text, None, 1), (None, text, "a", 1), (1, text + " more", "a", 2), (1, text + " more", "a", 2), (2, "other " + " ".join(f"thing{i} is here" for i in range(60)), None, 3), (3, None, "b", 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int").selectExpr("*", "'x' AS row", "0 AS copies", "1 AS m_id", "2 AS d_key", "3 AS `a.b`")
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing here matches")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = [r["doc_id"] for r in out.collect()]
        if name == "quality_rules":
            assert sorted(found, key=str) == [1, 1, 2, None, None]
        if name == "near_dedup":
            assert found.count(2) == 1 and found.count(1) <= 1
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert stage and cp.token_output(spark, docs, str(tmp_path)).count() == docs.count()
