"""Merkle manifests against plain trees, at sizes around the fan-out."""

import pytest
from pyspark.sql import functions as F

from kinweave.llm import manifest
from kinweave.llm import queries as q
from tests.llm import brute

NAMES = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, idx long, n long, node string"


def check(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = [(r["doc_id"], *(r[n] for n in NAMES)) for r in q.op12_manifest(spark, str(path)).collect()]
    want = [(rows[i][0], *held) for i, held in brute.manifest(rows).items()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"en": 65, None: 1, "de": 64, "é": 2, "": 3}, {f"l{k:02d}": 1 + k % 3 for k in range(70)}])
def test_trees(spark, tmp_path, sizes):
    rows = [(10 * k + len(lang or ""), "s", lang, k, f"Text {k} É") for lang, n in sizes.items() for k in range(n)]
    got = check(spark, rows, tmp_path)
    assert {r[-1] for r in got} <= {True, False} and len({r[3] for r in got}) == 1


def test_ties_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (None, None, None, None, "A"), (5, "a", "en", 1, "Same"), (5, "a", "en", 1, "Same"), (5, "b", "en", 1, "OTHER"), (6, "", "en", -3, "12:x\n-"), (7, "a", "en", 2**62, None)]
    check(spark, rows * 3 + [(1, "hot", "en", 3, "hot text")] * 200, tmp_path)


def test_any_change_is_seen(spark):
    """Each field, and the border between fields, is part of the leaf; proofs lead to the root from the right leaf only."""
    rows = [(k, "s1", "en", 11, "some text") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest.manifest(docs, changed={"source": F.lit("s"), "n_chars": F.lit("11")})
    held = found.select("leaf", "changed_leaf", "root", manifest.fold(F.col("leaf"), F.col("steps")).alias("same"), manifest.fold(F.col("changed_leaf"), F.col("steps")).alias("other")).collect()
    assert all(r["same"] == r["root"] != r["other"] and r["leaf"] != r["changed_leaf"] for r in held)
    assert len({r["leaf"] for r in held}) == 20


def test_other_groups_and_fanouts(spark):
    docs = spark.createDataFrame([(k, f"g{k % 2}", "x" * k) for k in range(30)], "`my id` long, `a.b` string, text string")
    found = manifest.manifest(docs, fields=("my id", "text"), group="a.b", order="my id", fanout=3)
    rows = found.select("g", "idx", "order", "root", manifest.fold(F.col("leaf"), F.col("steps")).alias("top"), F.size("steps").alias("n")).collect()
    assert all(r["root"] == r["top"] and r["n"] == 4 and r["idx"] == r["order"] // 2 for r in rows) and len(rows) == 30
