"""Partitions and dissection orders: balance, cuts against known ones, and separators that separate."""

import numpy as np
from pyspark.sql import functions as F

from kinweave.operators import graph, partition
from tests.test_graph import frame, vertices_of


def grid(n):
    at = lambda i, j: i * n + j + 1
    return [(at(i, j), at(i + a, j + b), 1.0) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < n]


def test_grid(spark):
    """A 16 x 16 grid in four parts: within 3 % of equal, and not far from the 32 links that straight cuts take."""
    edges = graph.build_graph(frame(spark, grid(16)))
    parts = partition.partition_kway(vertices_of(spark, range(1, 260)), edges, 4, small=8)
    row = partition.partition_quality(edges, parts).first()
    assert parts.count() == 259 and row["parts"] == 4 and row["largest"] <= 66
    assert row["cut"] <= 80  # a random partition cuts about 360 of 480


def test_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), round(float(w), 2)) for a, b, w in zip(rng.integers(1, 60, 150), rng.integers(1, 60, 150), rng.random(150) + 0.1) if a != b]
    edges = graph.build_graph(frame(spark, rows))
    weights = vertices_of(spark, range(1, 62)).withColumn("w", F.when(F.col("v") < 5, 9).otherwise(1).cast("long"))
    got = partition.heavy_edge_matching(edges, weights, 9.0).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["community"], []).append(r["v"])
    linked = {frozenset(x[:2]) for x in rows}
    assert len(got) == 61 and all(len(m) == 1 or (len(m) == 2 and frozenset(m) in linked and min(m) >= 5) for m in sizes.values())
    # No two free vertices that could join hands and are each other's only choice are left.
    assert sum(len(m) == 2 for m in sizes.values()) >= 15


def test_overweight_parts_shrink(spark):
    edges = graph.build_graph(frame(spark, grid(8)))
    parts = spark.createDataFrame([(v, 1, 0 if v <= 50 else 1) for v in range(1, 65)], "v long, w long, part int")
    sizes = {r["part"]: r["n"] for r in partition.refine(edges, parts, 2, 33, rounds=8).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) <= 33


def test_separators(spark):
    """What a level separates has no link left between its halves, and comes before its separator."""
    links = grid(12)
    edges = graph.build_graph(frame(spark, links))
    parts = spark.createDataFrame([(i * 12 + j + 1, 4 * (i // 6) + 2 * (j // 6) + (i % 6) // 3) for i in range(12) for j in range(12)], "v long, part int")
    part = {r["v"]: r["part"] for r in parts.collect()}
    rows = {r["v"]: r for r in partition.dissection_order(edges, parts).collect()}
    assert sorted(r["place"] for r in rows.values()) == list(range(144))
    assert sum(r["level"] == 0 for r in rows.values()) == 12
    for a, b, _ in links:
        cut = part[a] ^ part[b]
        levels = [rows[x]["level"] for x in (a, b)]
        assert not cut or any(0 <= lv <= 3 - cut.bit_length() for lv in levels)
    top = [r["place"] for r in rows.values() if r["level"] == 0]
    assert min(top) == 132


def test_nested_dissection(spark):
    edges = graph.build_graph(frame(spark, grid(5)))
    whole = partition.nested_dissection(vertices_of(spark, range(1, 26)), edges, depth=1, rounds=2).collect()
    assert sorted(r["place"] for r in whole) == list(range(25)) and 3 <= sum(r["level"] == 0 for r in whole) <= 7
    assert {r["place"] for r in whole if r["level"] == 0} == set(range(25 - sum(r["level"] == 0 for r in whole), 25))
