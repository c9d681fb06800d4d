"""Approximate nearest neighbours by descent: neighbours of neighbours are likely neighbours.

The first lists come from a few forests of random hyperplanes, whose leaves are searched exactly. Then, in rounds, each
row introduces its neighbours and those that it is a neighbour of to each other, unless both were there in the round
before. A row keeps its best ``width`` in a top-k aggregate; rounds end when few lists change. What is exchanged in a
round is at most ``2 * width`` vectors a row, so work grows with the rows and not with their square.

Input and result are those of ``knn``: id and features to src, rank (from 1), dst and dist, ordered by (dist, dst).
Distances are exact; which rows are found depends on seeds only, not on partitions. Recall is about 0.95 and more at the
default width on data without structure, and has to be measured on other data against ``knn_exact`` of a sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators.knn import _exact, _matrix, _rank, metric_name, nearest
from kinweave.functions import DISTANCE_DIGITS
from kinweave.plans.scratch import Rotation, materialize

_FOUND = "src long, dst long, dist double"
#: Rows whose projections set a hyperplane, at most, and rows of a leaf.
_SAMPLE, LEAF_ROWS = 2048, 256
#: Rows whose introductions are computed in one call, about.
_GROUP_ROWS = 256
_PAIRS = 1 << 16


def _planes(sample: np.ndarray, depth: int, forests: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each forest and level a direction and an offset: the plane halfway between two rows of the sample."""
    rng = np.random.default_rng(seed)
    shape = (forests, depth)
    a, b = (sample[rng.integers(0, len(sample), shape)] for _ in range(2))
    way = np.where((a == b).all(-1, keepdims=True), rng.normal(size=(*shape, sample.shape[1])), a - b)
    # The median of the sample splits evenly whatever the pair.
    offsets = np.median(np.einsum("nd,fld->nfl", sample, way), axis=0)
    return way, offsets


def _leaves(base: DataFrame, n: int, forests: int, seed: int, unit: bool) -> DataFrame:
    """forest, leaf, id, features: rows on the same side of all planes of a forest, in parts of about ``LEAF_ROWS``."""
    draw = F.xxhash64("id", F.lit(seed))
    share = min(1.0, 4 * _SAMPLE / n)
    picked = base.where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)).orderBy(draw, "id").limit(_SAMPLE).toArrow()
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
    sample = _matrix(picked) if picked.num_rows else np.zeros((1, 1))
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300) if unit else sample
    way, offsets = _planes(sample, depth, forests, seed)
    held = base.sparkSession.sparkContext.broadcast((way, offsets))

    def place(batches):
        way, offsets = held.value
        powers = 1 << np.arange(way.shape[1], dtype=np.int64)
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch]))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if unit else x
            for f in range(len(way)):
                leaf = ((x @ way[f].T > offsets[f]) @ powers).astype(np.int64) if way.shape[1] else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), f, np.int32)), pa.array(leaf), batch.column("id"), batch.column("features")], ["forest", "leaf", "id", "features"])

    placed = materialize(base.mapInArrow(place, f"forest int, leaf long, id long, features {base.schema['features'].dataType.simpleString()}"), "leaves")
    # A crowded leaf is dealt into parts by hash.
    sizes = placed.groupBy(F.col("forest").alias("s_forest"), F.col("leaf").alias("s_leaf")).agg(F.ceil(F.count("*") / (2 * LEAF_ROWS)).alias("parts"))
    dealt = placed.join(sizes, (F.col("forest") == F.col("s_forest")) & (F.col("leaf") == F.col("s_leaf")))
    return dealt.select("forest", "leaf", F.pmod(F.xxhash64("id", F.lit(seed), "forest"), F.col("parts")).alias("part"), "id", "features")


def _introduced(table: pa.Table, metric: str) -> pa.Table:
    """src, dst, dist of rows that are introduced to each other and would enter src's list.

    ``table`` has v (who introduces), c (a neighbour of v), new, worst (c's last distance so far) and features.
    """
    order = np.argsort(np.asarray(table.column("v")), kind="stable")
    v, c, new, worst = (np.asarray(table.column(k))[order] for k in ("v", "c", "new", "worst"))
    x = _matrix(table)[order]
    bounds = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if not new[a:b].any():
            continue
        own, held = x[a:b], worst[a:b]
        rough = _rough(own, metric)
        ask = (new[a:b, None] | new[None, a:b]) & (rough <= held[:, None] + 1e-6 * (1 + np.abs(held[:, None])))
        np.fill_diagonal(ask, False)
        i, j = np.nonzero(ask)
        if len(i):
            out.append((i + a, j + a))
    if not out:
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
    i, j = (np.concatenate(k) for k in zip(*out))
    # A pair that several rows introduce is measured once.
    key = np.unique(np.stack([c[i], c[j]]), axis=1, return_index=True)[1]
    i, j = i[key], j[key]
    dist = np.concatenate([_exact(x[i[k : k + _PAIRS]], x[j[k : k + _PAIRS]][:, None], metric)[:, 0] for k in range(0, len(i), _PAIRS)])
    dist = np.round(dist, DISTANCE_DIGITS) + 0.0
    better = dist <= worst[i]
    return pa.table({"src": c[i][better], "dst": c[j][better], "dist": dist[better]})


def _rough(x: np.ndarray, metric: str) -> np.ndarray:
    dots = x @ x.T
    if metric in ("l2", "euclidean"):
        norms = np.diag(dots)
        squared = np.maximum(norms[:, None] + norms[None, :] - 2 * dots, 0)
        return squared if metric == "l2" else np.sqrt(squared)
    if metric == "cosine":
        norms = np.sqrt(np.diag(dots))
        dots = dots / np.maximum(norms[:, None] * norms[None, :], 1e-300)
    return 1 - dots


def _best(found: DataFrame, width: int) -> DataFrame:
    """The ``width`` best of each src; a pair that was known before isn't new."""
    pairs = found.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= width)


def knn_descent(rows: DataFrame, k: int = 30, distance: str = "l2", include_self: bool = True, width: int | None = None, forests: int = 4, max_rounds: int = 12, settled: float = 0.002, seed: int = 1) -> DataFrame:
    """Approximate neighbours; ``width`` (k and half as many more, at least 24) is the length of the lists that descend.

    Rounds end when less than the share ``settled`` of the lists' entries are new. Who is introduced by a row that many
    have as a neighbour is limited to ``width`` of them, drawn by hash, so no row's introductions grow with the table.
    """
    metric = metric_name(distance)
    spark = rows.sparkSession
    base = materialize(rows.select("id", "features"), "features")
    n, exact = base.agg(F.count("*"), F.min(F.forall("features", lambda x: x == x.cast("float").cast("double")))).first()
    # Numbers that floats hold exactly are sent as floats; they are doubles again before anything is computed.
    base = base.select("id", F.col("features").cast("array<float>").alias("features")) if exact else base
    width = width or max(k + k // 2, 24)
    if not n:
        return _rank(spark.createDataFrame([], _FOUND), k)

    def search(leaf: pa.Table) -> pa.Table:
        ids, x = np.asarray(leaf.column("id")), _matrix(leaf)
        src, dst, dist = nearest(ids, x, ids, x, width, metric, include_self)
        return pa.table({"src": src, "dst": dst, "dist": dist})

    leaves = _leaves(base, n, forests, seed, metric == "cosine")
    first = leaves.groupBy("forest", "leaf", "part").applyInArrow(search, _FOUND)
    lists = Rotation(spark, "lists")
    held = lists.write(_best(first.withColumn("new", F.lit(True)), width))
    n_groups = max(1, math.ceil(n / _GROUP_ROWS))
    for round in range(max_rounds):
        n_new, n_held = held.agg(F.count_if("new"), F.count("*")).first()
        if n_new <= settled * n_held:
            break
        ahead = held.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("c"), "new")
        drawn = F.row_number().over(Window.partitionBy("dst").orderBy(F.xxhash64("src", "dst", F.lit(round)), "src"))
        back = held.where("src <> dst").withColumn("drawn", drawn).where(F.col("drawn") <= width).select(F.col("dst").alias("v"), F.col("src").alias("c"), "new")
        near = ahead.union(back).repartition("v").groupBy("v", "c").agg(F.max("new").alias("new"))
        # Rows whose neighbours have all met before introduce nobody.
        near = near.withColumn("meets", F.max("new").over(Window.partitionBy("v"))).where("meets").drop("meets")
        worst = held.groupBy(F.col("src").alias("w_id")).agg(F.when(F.count("*") == width, F.max("dist")).otherwise(F.lit(math.inf)).alias("worst"))
        vectors = base.join(worst, F.col("id") == F.col("w_id")).select("id", "features", "worst")
        guests = near.join(vectors, F.col("c") == F.col("id")).select(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(n_groups)).alias("host"), "v", "c", "new", "worst", "features")
        met = guests.groupBy("host").applyInArrow(lambda table: _introduced(table, metric), _FOUND)
        held = lists.write(_best(held.select("src", "dst", "dist", F.lit(False).alias("new")).union(met.withColumn("new", F.lit(True))), width))
    return held.where(F.col("rank") <= k).select("src", F.col("rank").cast("int").alias("rank"), "dst", "dist")
