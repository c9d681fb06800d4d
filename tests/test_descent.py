"""Neighbours by descent: recall on data without clusters, growth of what is exchanged, and bounds on crowds and hubs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import descent, knn
from kinweave.plans.cluster import fast_cluster


def rows_of(spark, x, first=1):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_recall_on_unscaled_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    want, found = pairs(knn.knn_exact(rows, 10)), descent.knn_descent(rows, 10)
    got = pairs(found)
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)
    assert found.where("rank = 1 AND src <> dst").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_distances_are_exact(spark, metric):
    x = np.random.default_rng(4).normal(size=(700, 8))
    rows = rows_of(spark, x)
    want = {(r["src"], r["dst"]): r["dist"] for r in knn.knn_exact(rows, 8, metric, include_self=False).collect()}
    got = {(r["src"], r["dst"]): r["dist"] for r in descent.knn_descent(rows, 8, metric, include_self=False).collect()}
    both = want.keys() & got.keys()
    assert len(both) >= 0.9 * len(want) and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in both)
    assert not any(a == b for a, b in got)


def test_exchange_grows_with_rows(spark, monkeypatch):
    """Rows that meet in a round stay in proportion to the rows; a pair of all rows would grow with their square."""
    met = {}
    introduced = descent._best
    for n in (500, 1000, 2000):
        seen = []
        monkeypatch.setattr(descent, "_best", lambda found, width: seen.append(found) or introduced(found, width))
        descent.knn_descent(rows_of(spark, np.random.default_rng(n).normal(size=(n, 12))), 6, max_rounds=1)
        met[n] = seen[0].count()
    assert met[2000] <= 6 * met[500] and met[2000] < 2000 * 2000 / 4


def test_copies_and_hub(spark):
    """A third of the rows are one vector, and one row is near to all others."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((300, 5)), rng.normal(size=(599, 5)) * 3, np.zeros((1, 5))])
    rows = rows_of(spark, x)
    got = {}
    for r in descent.knn_descent(rows, 5).collect():
        got.setdefault(r["src"], []).append(r["dist"])
    assert all(len(d) == 5 for d in got.values()) and len(got) == 900
    assert all(max(got[i]) == 0 for i in range(1, 301))


def test_few_rows(spark):
    assert descent.knn_descent(rows_of(spark, np.zeros((0, 3))), 3).count() == 0
    assert pairs(descent.knn_descent(rows_of(spark, np.eye(2)), 3)) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_clustering_with_descent(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 10)) * 20
    truth = rng.integers(0, 5, 250)
    rows = rows_of(spark, centers[truth] + rng.normal(size=(250, 10)))
    found = {r["id"]: r["community"] for r in fast_cluster(rows, k=12, neighbors="descent").collect()}
    of = {}
    for i, t in enumerate(truth):
        of.setdefault(found[i + 1], set()).add(int(t))
    assert len(found) == 250 and all(len(t) == 1 for t in of.values())


@pytest.mark.parametrize("scale, kind", [(0.25, "float"), (0.1, "double")])
def test_floats_are_sent_where_they_are_exact(spark, monkeypatch, scale, kind):
    rng = np.random.default_rng(13)
    x = rng.integers(-40, 40, (300, 6)) * scale
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, features array<double>")
    sent, leaves = [], descent._leaves
    monkeypatch.setattr(descent, "_leaves", lambda base, *a: sent.append(base) or leaves(base, *a))
    got = {(r["src"], r["dst"]): r["dist"] for r in descent.knn_descent(rows, 4).collect()}
    assert sent[0].schema["features"].dataType.simpleString() == f"array<{kind}>"
    assert all(d == round(float(((x[a] - x[b]) ** 2).sum()), 9) + 0.0 for (a, b), d in got.items())
