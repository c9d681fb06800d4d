"""Vertex colourings; ``edges`` are symmetric and colours start at 0.

Priorities are hashes of ids, so a colouring depends on neither the partitions nor the number of tasks. Rounds of
joins read only the edges whose ends are still open: a table of them is written whenever half have closed. The state of
a loop goes through the shared folder.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window, functions as F

from kinweave.plans.scratch import Rotation, materialize


#: A round of ``color_distance_one``: one statement, as it is analysed once in each round.
_ROUND = """WITH ends AS (SELECT src, max(o.color < 0 AND after) AS beaten, collect_set(CASE WHEN o.color >= 0 THEN o.color END) AS used FROM {near} JOIN {state} o ON dst = o.v GROUP BY src),
held AS (SELECT v, color, coalesce(beaten, false) AS beaten, coalesce(used, CAST(array() AS array<int>)) AS used FROM {state} LEFT JOIN ends ON v = src)
SELECT v, CASE WHEN color >= 0 THEN color WHEN beaten THEN -1 ELSE array_min(array_except(sequence(0, size(used)), used)) END AS color FROM held"""


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select("src", "dst").distinct()


def _rank(v: str, *numbers: int):
    return F.struct(F.xxhash64(v, *map(F.lit, numbers)), F.col(v))


def color_distance_one(vertices: DataFrame, edges: DataFrame, seed: int = 1, max_rounds: int | None = None) -> DataFrame:
    """v, color with no two neighbours alike: in rounds, vertices whose hash beats all their uncoloured neighbours' take the least free colour.

    A round is one job: it reads the edges of open vertices, and the colours of their other ends. Each round colours a vertex; a clique
    takes as many as it has.
    """
    spark = vertices.sparkSession
    states, frontier = Rotation(spark, "colors"), Rotation(spark, "open")
    # Whether the other end goes first never changes.
    near = frontier.write(_pairs(edges).select("src", "dst", (_rank("dst", seed) > _rank("src", seed)).alias("after")).hint("rebalance"))
    left = F.count_if(F.col("color") < 0)
    state, seen = states.observed(vertices.select("v", F.lit(-1).alias("color")).distinct().hint("rebalance"), open=left)
    written = seen["open"]
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        if not seen["open"]:
            return state.select("v", "color")
        if 2 * seen["open"] <= written:
            still = state.where("color < 0").select(F.col("v").alias("o_v"))
            near, written = frontier.write(near.join(still, F.col("src") == F.col("o_v")).select("src", "dst", "after")), seen["open"]
        state, seen = states.observed(spark.sql(_ROUND, near=near, state=state), open=left)
    raise RuntimeError(f"colouring not done after {max_rounds} rounds")


def color_max_min(vertices: DataFrame, edges: DataFrame, n_colors: int = 16, n_hashes: int = 2, seed: int = 1) -> DataFrame:
    """v, color from at most ``n_colors``: for each hash of each of n_colors / 4 rounds, uncoloured local maxima and minima take the next two colours; the rest get the last.

    Hashes come from the ids of an edge's ends, so a round groups the open edges without a join, and then drops those with
    an end that has got its colour.
    """
    spark = vertices.sparkSession
    states, frontier = Rotation(spark, "colors"), Rotation(spark, "open")
    near = frontier.write(_pairs(edges).hint("rebalance"))
    state = states.write(vertices.select("v", F.lit(-1).alias("color")).distinct().hint("rebalance"))
    last = 2 * n_hashes * max(1, n_colors // 4)
    for k in range(last // 2):
        own, other = _rank("src", seed, k), _rank("dst", seed, k)
        seen = near.groupBy(F.col("src").alias("n_v")).agg((F.max(other) > F.first(own)).alias("below"), (F.min(other) < F.first(own)).alias("above"))
        joined = state.join(seen, F.col("v") == F.col("n_v"), "left")
        color = F.when(F.col("color") >= 0, F.col("color")).when(~F.coalesce("below", F.lit(False)), 2 * k).when(~F.col("above"), 2 * k + 1).otherwise(-1)
        state = states.write(joined.select("v", color.cast("int").alias("color")))
        if k + 1 < last // 2:
            still = state.where("color < 0").select("v")
            near = near.join(still.select(F.col("v").alias("a_v")), F.col("src") == F.col("a_v")).join(still.select(F.col("v").alias("b_v")), F.col("dst") == F.col("b_v"))
            near = frontier.write(near.select("src", "dst"))
    return state.select("v", F.when(F.col("color") < 0, last).otherwise(F.col("color")).cast("int").alias("color"))


def color_balanced(vertices: DataFrame, edges: DataFrame, colors: DataFrame | None = None, least_used: bool = False, max_rounds: int = 20, seed: int = 1) -> DataFrame:
    """A distance-1 colouring whose over-full colours are emptied towards the mean.

    In rounds, vertices of colours above the mean that beat all such neighbours by hash ask for an allowed colour below
    it: the first one, or the least used. A colour's room is dealt by hash: of those that ask, a share as large as
    the room over their number moves. The colours' sizes stay a table, with a row for each colour.
    """
    pairs = materialize(_pairs(edges).hint("rebalance"), "pairs")
    rotation = Rotation(vertices.sparkSession, "colors")
    state = rotation.write((colors if colors is not None else color_distance_one(vertices, edges, seed)).select("v", "color").hint("rebalance"))
    for k in range(max_rounds):
        counts = state.groupBy("color").agg(F.count("*").alias("n"))
        whole = Window.partitionBy(F.lit(1))
        sizes = counts.withColumn("room", F.ceil(F.sum("n").over(whole) / F.count("*").over(whole)).cast("long"))  # a row for each colour
        order = F.struct(*(["n"] if least_used else []), "color")
        below = sizes.where("n < room").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["color"]).alias("below"))
        full = sizes.where("n > room").select(F.col("color").alias("f_color"))
        over = state.join(full, F.col("color") == F.col("f_color")).select("v", _rank("v", seed, k).alias("h"))
        a, b = (over.select(F.col("v").alias(f"{x}_v"), F.col("h").alias(f"{x}_h")) for x in "ab")
        # The edges of those above the mean: whether another of them goes first, and the colours at their other ends.
        ends = pairs.join(a, F.col("src") == F.col("a_v")).join(state.select(F.col("v").alias("c_v"), F.col("color").alias("c")), F.col("dst") == F.col("c_v")).join(b, F.col("dst") == F.col("b_v"), "left")
        seen = ends.groupBy(F.col("src").alias("n_v")).agg(F.max(F.coalesce(F.col("b_h") > F.col("a_h"), F.lit(False))).alias("beaten"), F.collect_set("c").alias("used"))
        asking = over.join(seen, F.col("v") == F.col("n_v"), "left").where("NOT coalesce(beaten, false)").crossJoin(below)  # one row
        allowed = F.array_except("below", F.coalesce("used", F.array().cast("array<int>")))
        asking = materialize(asking.select("v", F.get(allowed, F.lit(0)).alias("to")).where("to IS NOT NULL"), "asking")
        if not asking.limit(1).count():
            break
        wanted = asking.groupBy(F.col("to").alias("w_to")).agg(F.count("*").alias("asked"))
        share = wanted.join(sizes, F.col("w_to") == F.col("color")).select("w_to", F.least(F.lit(1.0), (F.col("room") - F.col("n")) / F.col("asked")).alias("share"))
        draw = F.pmod(F.xxhash64("v", F.lit(seed + 1), F.lit(k)), F.lit(1 << 20))
        moved = asking.join(share, F.col("to") == F.col("w_to")).where(draw < F.col("share") * (1 << 20)).select(F.col("v").alias("m_v"), "to")
        state = rotation.write(state.join(moved, F.col("v") == F.col("m_v"), "left").select("v", F.coalesce("to", "color").cast("int").alias("color")))
    return state
