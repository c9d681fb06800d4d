"""Neighbours among many equal vectors, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import knn, links


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("include_self", [True, False])
def test_copies_are_ordered_by_id(metric, include_self):
    rng = np.random.default_rng(5)
    rows = np.concatenate([np.repeat(rng.normal(size=(3, 8)), [70, 40, 5], axis=0), rng.normal(size=(60, 8)), np.zeros((30, 8))])
    ids = rng.permutation(len(rows)).astype(np.int64) + 100
    dist = np.round(knn._exact(rows, np.broadcast_to(rows, (len(rows), *rows.shape)), metric), 9) + 0.0
    want = []
    for i, own in enumerate(ids):
        if not include_self:
            dist[i, i] = np.inf
        want += [(own, ids[j], dist[i, j]) for j in np.lexsort((ids, dist[i]))[:10]]
    src, dst, found = knn.nearest(ids, rows, ids, rows, 10, metric, include_self)
    assert list(zip(src, dst)) == [w[:2] for w in want]
    assert np.allclose(found, [w[2] for w in want], atol=2e-9)


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_rows_are_sent_in_proportion(spark, n):
    """However many rows there are, each is sent to sixteen pairs of blocks (to twice as many as there were blocks of 2,048 before)."""
    base = spark.range(1, n + 1).select("id", F.array(F.col("id").cast("double")).alias("features"))
    sent = knn._block_pairs(base, 131_072)
    assert sent.count() == 16 * n and sent.groupBy("a", "b").count().count() == 16 * 17 // 2


def test_pairs_of_blocks_are_searched_both_ways(spark, monkeypatch):
    monkeypatch.setattr(knn, "_LEAST_ROWS", 16)
    rng = np.random.default_rng(11)
    x = rng.integers(0, 4, (120, 5)).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, features array<double>")
    src, dst, dist = knn.nearest(np.arange(120), x, np.arange(120), x, 7, "l2", True)
    got = sorted((r["src"], r["dst"], r["dist"]) for r in knn.knn_exact(rows, 7).collect())
    assert got == sorted(zip(src.tolist(), dst.tolist(), dist.tolist()))


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("scale, offset", [(1, 0), (1, 1e5), (1e-3, 1e6), (1e-25, 0), (1e20, 0)])
def test_single_precision_only_proposes(metric, scale, offset):
    """Rows that single precision can't tell apart, or whose squares it can't hold, are searched as exactly as others."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(900, 6)) * scale + offset
    dist = np.round(knn._exact(rows, np.broadcast_to(rows, (len(rows), *rows.shape)), metric), 9) + 0.0
    src, dst, found = knn.nearest(np.arange(900), rows, np.arange(900), rows, 5, metric, True)
    want = np.concatenate([np.lexsort((np.arange(900), dist[i]))[:5] for i in range(900)])
    assert (src == np.repeat(np.arange(900), 5)).all() and (dst == want).all()


def test_coarse_limits_are_reached_by_enough_rows():
    rng = np.random.default_rng(4)
    for width in (8, 300, 2000, 2403):
        rough = rng.normal(size=(40, width)).astype(np.float32)
        assert ((rough <= knn._last(rough, 8)[:, None]).sum(1) >= 8).all()


def test_rows_without_numbers_hide_no_others():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2000, 4))
    rows[rng.random(2000) < 0.6] = np.nan
    held = np.flatnonzero(~np.isnan(rows[:, 0]))
    every, alone = (knn.nearest(held, rows[held], others, rows[others], 4, "l2", True) for others in (np.arange(2000), held))
    assert len(every[0]) == 4 * len(held) and all((x == y).all() for x, y in zip(every, alone))


def test_links_read_their_neighbours_once(spark):
    """Neighbours that are a plan, as of a search, are found once, though links need the lists of both ends."""
    runs = spark.sparkContext.accumulator(0)

    def search(table):
        runs.add(table.num_rows)
        return table

    rows = spark.range(40).selectExpr("id AS src", "explode(array(id, (id + 1) % 40, (id + 5) % 40)) AS dst", "cast(dst AS double) AS dist")
    near = knn._rank(rows.groupBy("src").applyInArrow(search, "src long, dst long, dist double"), 3)
    found = links.jaccard_links(near).collect()
    assert len(found) == 120 and {r["weight"] for r in found if r["src"] == r["dst"]} == {0.5}
    assert runs.value == 120
