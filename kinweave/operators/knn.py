"""k nearest rows, exactly by pairs of blocks or approximately by the lists of nearest centroids.

Input has ``id`` and ``features`` (an array of doubles); the result has src, rank (from 1), dst and dist,
ordered by (dist rounded to 9 digits, dst). A row is its own neighbour unless ``include_self`` is false.
Rows with a null id or null features, or whose length differs from the first row's, are an error of the
caller and make the job fail.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.functions import DISTANCE_DIGITS
from kinweave.plans.scratch import materialize

METRICS = ("l2", "euclidean", "cosine", "ip")
#: Pairs whose distances are computed again at once.
_PAIRS = 1 << 16
_ROWS = "src long, dst long, dist double"
#: Blocks of ``knn_exact`` that rows are dealt into, with this many rows at least, and entries of one product.
_BLOCKS, _LEAST_ROWS, _CELLS = 16, 512, 1 << 22
#: Groups that a coarse pass takes the least entries of, for each neighbour asked for.
_GROUPS = 24


def metric_name(name: str) -> str:
    """The metric's name; the common misspelling of "euclidean" is accepted."""
    name = "euclidean" if name == "euclidian" else name
    if name not in METRICS:
        raise ValueError(f"distance is one of {METRICS}")
    return name


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of ``a`` (n, d) to its own candidates ``b`` (n, m, d)."""
    if metric in ("l2", "euclidean"):
        squared = ((b - a[:, None, :]) ** 2).sum(-1)
        return squared if metric == "l2" else np.sqrt(squared)
    dots = (b * a[:, None, :]).sum(-1)
    if metric == "cosine":
        dots = dots / np.maximum(np.linalg.norm(a, axis=-1)[:, None] * np.linalg.norm(b, axis=-1), 1e-300)
    return 1 - dots


def nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, metric: str, include_self: bool, held: tuple | None = None):
    """(src, dst, dist) of the k nearest rows of ``b`` for each row of ``a``: a coarse pass by one product, then an exact one over all rows that may be among them, ties included.

    ``held`` are ``b``'s ``_factors`` if they are at hand.
    """
    if not len(a) or not len(b):
        return np.empty(0, ids.dtype), np.empty(0, others.dtype), np.empty(0)
    row, near = _candidates(a, b, min(len(b), k + (not include_self)), metric, held or _factors(b, metric))
    dist = np.concatenate([_exact(a[row[i : i + _PAIRS]], b[near[i : i + _PAIRS]][:, None], metric)[:, 0] for i in range(0, max(1, len(row)), _PAIRS)])
    dst = others[near]
    dist = np.round(dist, DISTANCE_DIGITS) + 0.0
    if not include_self:
        dist = np.where(dst == ids[row], np.inf, dist)
    order = np.lexsort((dst, dist, row))
    row, dst, dist = row[order], dst[order], dist[order]
    keep = np.isfinite(dist) & (np.arange(len(row)) - np.searchsorted(row, row) < k)
    return ids[row[keep]], dst[keep], dist[keep]


def _factors(b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """What a coarse product has on the side of ``b``, in single and in double precision, and the largest norm."""
    norms = np.linalg.norm(b, axis=1)
    if metric == "cosine":
        right = b / np.maximum(norms, 1e-300)[:, None]
    elif metric == "ip":
        right = b
    else:
        right = np.hstack([b, (b * b).sum(1)[:, None]])
    with np.errstate(over="ignore"):
        return right.astype(np.float32), right, np.fmax.reduce(norms)


def _candidates(a: np.ndarray, b: np.ndarray, need: int, metric: str, held: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` that may be among the ``need`` nearest, by a product in single precision.

    Where many rows are too close for that, and where squares might overflow, the product is in double precision.
    """
    single, double, other = held
    one = np.linalg.norm(a, axis=1)
    if metric == "cosine":
        left = -a / np.maximum(one, 1e-300)[:, None]
    elif metric == "ip":
        left = -a
    else:
        left = np.hstack([-2 * a, np.ones((len(a), 1))])
    for right in (single, double):
        if right is single and not (one.max() + other) ** 2 < 1e36:
            continue
        rough = left.astype(right.dtype, copy=False) @ right.T
        last = _last(rough, need).astype(float)
        most = last + _tolerance(a.shape[1], one, other, last, metric, float(np.finfo(right.dtype).eps))
        # Rounded up, a limit leaves no row out.
        may = rough <= np.nextafter(most.astype(right.dtype), np.inf, dtype=right.dtype)[:, None]
        if right is double or np.count_nonzero(may) <= 4 * need * len(a):
            break
    return np.divmod(np.flatnonzero(may), len(b))


def _last(rough: np.ndarray, need: int) -> np.ndarray:
    """For each row a number that ``need`` entries or more don't exceed: the last of the first least ones of groups, which is close to their last, or in short rows that last itself."""
    groups, n = _GROUPS * need, rough.shape[1]
    if n >= 4 * groups:
        least = rough[:, : n - n % groups].reshape(len(rough), -1, groups).min(1)
        last = np.partition(least, need - 1, axis=1)[:, need - 1]
        if not np.isnan(last).any():
            return last
    return np.partition(rough, need - 1, axis=1)[:, need - 1]


def _tolerance(width: int, one: np.ndarray, other: float, last: np.ndarray, metric: str, eps: float) -> np.ndarray:
    """For each row how far beyond its last coarse distance a row may be that equals it after rounding; ``one`` are the norms, ``other`` the largest on the other side."""
    error = 8 * (width + 8) * eps
    step = 2 * 10.0**-DISTANCE_DIGITS
    if metric == "cosine":
        return np.full(len(one), step + error)
    if metric == "ip":
        return step + error * one * other
    error = error * (one + other) ** 2
    if metric == "l2":
        return step + error
    last = np.sqrt(np.maximum(last + one**2, 0) + error)
    return error + 2 * step * last + step**2


def _rank(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def _matrix(table: pa.Table, column: str = "features") -> np.ndarray:
    held = table.column(column).combine_chunks()
    return np.asarray(held.flatten(), np.float64).reshape(len(held), -1)


def knn_exact(rows: DataFrame, k: int = 30, distance: str = "l2", include_self: bool = True, block_rows: int = 131_072) -> DataFrame:
    """Exact neighbours: rows are dealt into blocks and each pair of blocks is searched by one task, both ways.

    A row is sent once for each block. There are ``_BLOCKS`` of them, so what is shuffled grows with the rows; beyond
    ``_BLOCKS * block_rows`` rows there are more, as a task holds two blocks. Work grows with the square of the rows;
    ``knn_lists`` is for large tables.
    """
    metric = metric_name(distance)
    base = rows.select("id", "features")

    def pair(key, table):
        a, b = (x.as_py() for x in key)
        block = np.asarray(table.column("block"))
        ids, x = np.asarray(table.column("id")), _matrix(table)
        ways = [(block == a, block == b)] if a == b else [(block == a, block == b), (block == b, block == a)]
        parts = [_searched(ids[mine], x[mine], ids[theirs], x[theirs], k, metric, include_self) for mine, theirs in ways]
        return pa.table(dict(zip(("src", "dst", "dist"), (np.concatenate(c) for c in zip(*parts)))))

    return _rank(_block_pairs(base, block_rows).groupBy("a", "b").applyInArrow(pair, _ROWS), k)


def _block_pairs(base: DataFrame, block_rows: int) -> DataFrame:
    """The rows of each pair of blocks a <= b, with their own block; a row is in as many pairs as there are blocks."""
    n = base.count()
    n_blocks = max(1, min(_BLOCKS, math.ceil(n / _LEAST_ROWS)), math.ceil(n / block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    sent = base.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other"), "id", "features")
    sent = sent.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "features")
    # A partition for each pair, so that small ones aren't put together in few tasks.
    return sent.repartition(n_blocks * (n_blocks + 1) // 2, "a", "b")


def _searched(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, metric: str, include_self: bool):
    """``nearest``, so many rows of ``a`` at once that a product has about ``_CELLS`` entries."""
    step = max(1, _CELLS // max(1, len(b)))
    held = _factors(b, metric) if len(b) else None
    parts = [nearest(ids[at : at + step], a[at : at + step], others, b, k, metric, include_self, held) for at in range(0, max(1, len(a)), step)]
    return tuple(np.concatenate(c) for c in zip(*parts))


def knn_lists(rows: DataFrame, k: int = 30, distance: str = "l2", include_self: bool = True, n_lists: int | None = None, probes: int = 8, block_rows: int = 4096, seed: int = 1) -> DataFrame:
    """Approximate neighbours: every row is in the list of its nearest centroid and searches those of its ``probes`` nearest.

    Centroids are a sample of ``n_lists`` rows, by default the square root of the rows', which the driver holds. A list of more than ``block_rows`` rows is dealt into blocks that are
    searched side by side, so a crowded list is split over tasks. Recall rises with ``probes``.
    """
    metric = metric_name(distance)
    spark = rows.sparkSession
    base = rows.select("id", "features")
    n = base.count()
    if not n:
        return _rank(spark.createDataFrame([], _ROWS), k)
    n_lists = n_lists or max(1, math.isqrt(n))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    picked = base.where(draw < min(1.0, 3 * n_lists / n) * (1 << 30)).orderBy(draw, "id").limit(n_lists).collect() or base.limit(1).collect()
    held = spark.sparkContext.broadcast(np.array([r["features"] for r in picked], float))
    near_metric = "l2" if metric == "euclidean" else metric

    def place(batches, count=1):
        for batch in batches:
            centroids = held.value
            for at in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(at, 2048)])
                ids = np.asarray(part.column("id"))
                src, dst, _ = nearest(np.arange(len(ids)), _matrix(part), np.arange(len(centroids)), centroids, min(count, len(centroids)), near_metric, True)
                yield pa.RecordBatch.from_arrays([pa.array(dst.astype(np.int32)), *(part.column(c).take(pa.array(src)).combine_chunks() for c in ("id", "features"))], ["list", "id", "features"])

    schema = "list int, id long, features array<double>"
    stored = base.mapInArrow(place, schema)
    asking = base.mapInArrow(lambda batches: place(batches, probes), schema)
    sizes = stored.groupBy(F.col("list").alias("s_list")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    sizes = F.broadcast(materialize(sizes, "lists"))  # one row for each list
    stored = stored.join(sizes, F.col("list") == F.col("s_list")).select("list", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("block"), "id", "features")
    asking = asking.join(sizes, F.col("list") == F.col("s_list")).select("list", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "id", "features")

    def search(mine, theirs):
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        b, others = _matrix(theirs), np.asarray(theirs.column("id"))
        parts = [nearest(np.asarray(p.column("id")), _matrix(p), others, b, k, metric, include_self) for p in (mine.slice(at, 2048) for at in range(0, mine.num_rows, 2048))]
        return pa.table(dict(zip(("src", "dst", "dist"), (np.concatenate(x) for x in zip(*parts)))))

    return _rank(asking.groupBy("list", "block").cogroup(stored.groupBy("list", "block")).applyInArrow(search, _ROWS), k)
