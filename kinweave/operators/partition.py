"""Balanced k-way partitions of a graph, and orders by nested dissection.

A partition is made in levels: heavy edges are contracted by handshakes until the graph is small, its vertices are
cut into k parts of equal weight along a breadth-first order, and on the way back each level's vertices move to better
parts as far as there is room. All steps are joins, groups and ranges; no part and no graph is ever in one task.

``edges`` are symmetric; loops don't matter. Vertices without edges belong to parts too.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.graph import contract
from kinweave.operators.ordering import reverse_cuthill_mckee
from kinweave.plans.ranking import global_rank, running_sum
from kinweave.plans.scratch import materialize


def heavy_edge_matching(edges: DataFrame, weights: DataFrame, most: float, rounds: int = 2, seed: int = 1) -> DataFrame:
    """v and community (the least of the pair): in rounds, vertices that are each other's heaviest free neighbour join hands.

    ``weights`` has v and w; a pair weighs ``most`` at most. Of equally heavy neighbours the one counts whose link has the
    greatest hash, which is the same seen from both ends.
    """
    free = weights.select("v", "w")
    matched = None
    for k in range(rounds):
        a, b = (free.select(F.col("v").alias(f"{x}_v"), F.col("w").alias(f"{x}_w")) for x in "ab")
        near = edges.join(a, F.col("src") == F.col("a_v")).join(b, F.col("dst") == F.col("b_v")).where((F.col("src") != F.col("dst")) & (F.col("a_w") + F.col("b_w") <= most))
        rank = F.struct("weight", F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed), F.lit(k)), "dst")
        asked = materialize(near.groupBy(F.col("src").alias("v")).agg(F.max(rank)["dst"].alias("to")), "asked")
        other = asked.select(F.col("v").alias("o_v"), F.col("to").alias("o_to"))
        hands = materialize(asked.join(other, (F.col("to") == F.col("o_v")) & (F.col("v") == F.col("o_to"))).select("v", F.least("v", "to").alias("community")), "hands")
        matched = hands if matched is None else matched.union(hands)
        free = free.join(hands.select(F.col("v").alias("h_v")), F.col("v") == F.col("h_v"), "left_anti")
    held = weights.select("v").join(matched.select(F.col("v").alias("m_v"), "community"), F.col("v") == F.col("m_v"), "left")
    return held.select("v", F.coalesce("community", "v").alias("community"))


def _first_parts(edges: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """v, w and part: runs of equal weight along a breadth-first order of the components."""
    order = reverse_cuthill_mckee(weights.select("v"), edges).select(F.col("v").alias("o_v"), "place")
    placed = weights.join(order, F.col("v") == F.col("o_v")).withColumn("one", F.lit(0))
    sums = running_sum(placed.select("one", "v", "w", "place"), "one", [F.col("place")], F.col("w").cast("double"), "ahead", "whole")
    part = F.floor((F.col("ahead") + F.col("w") / 2) * k / F.col("whole"))
    return sums.select("v", "w", F.least(part, F.lit(k - 1)).cast("int").alias("part"))


def refine(edges: DataFrame, parts: DataFrame, k: int, most: float, rounds: int = 4, seed: int = 1) -> DataFrame:
    """``parts`` (v, w, part) after rounds of moves: a vertex goes to the part that it has most weight in, if that cuts less.

    In a round vertices move to higher parts only, in the next to lower ones, so neighbours don't change places. Moves into
    a part are ranked by what they gain, and made while the part weighs ``most`` at most. From parts that weigh more,
    vertices go whatever it costs, the cheapest first, until they don't.
    """
    state, idle = parts, 0
    for turn in range(rounds):
        sizes = state.groupBy(F.col("part").alias("s_part")).agg(F.sum("w").alias("size"))  # k rows at most
        to = state.select(F.col("v").alias("t_v"), F.col("part").alias("t_part"))
        near = edges.where("src <> dst").join(to, F.col("dst") == F.col("t_v")).groupBy("src", "t_part").agg(F.sum("weight").alias("e"))
        held = near.join(state, F.col("src") == F.col("v"))
        way = F.col("t_part") > F.col("part") if turn % 2 == 0 else F.col("t_part") < F.col("part")
        best = F.max(F.when(way, F.struct("e", (-F.col("t_part")).alias("minus")))).alias("best")
        own = F.sum(F.when(F.col("t_part") == F.col("part"), F.col("e")).otherwise(0.0)).alias("own")
        asked = held.groupBy("v", "w", "part").agg(best, own).where("best IS NOT NULL")
        asked = asked.select("v", "w", "part", (-F.col("best.minus")).alias("to"), F.round(F.col("best.e") - F.col("own"), 9).alias("gain"))
        asked = asked.join(sizes, F.col("part") == F.col("s_part")).withColumn("excess", F.col("size") - most).drop("s_part", "size")
        asked = asked.where("gain > 0 OR excess > 0")
        order = [F.col("gain").desc(), F.xxhash64("v", F.lit(seed), F.lit(turn)), F.col("v")]
        leaving = running_sum(asked, "part", order, F.col("w").cast("double"), "left_before", "leaving")
        leaving = leaving.where((F.col("gain") > 0) | (F.col("left_before") < F.col("excess"))).drop("left_before", "leaving", "excess")
        coming = running_sum(leaving, "to", order, F.col("w").cast("double"), "ahead", "coming")
        room = sizes.select("s_part", (F.lit(most) - F.col("size")).alias("room"))
        moved = coming.join(room, F.col("to") == F.col("s_part"), "left").where(F.col("ahead") + F.col("w") <= F.coalesce("room", F.lit(most)))
        moved = materialize(moved.select(F.col("v").alias("m_v"), F.col("to").alias("m_to")), "moved")
        idle = 0 if moved.limit(1).count() else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        state = materialize(state.join(moved, F.col("v") == F.col("m_v"), "left").select("v", "w", F.coalesce("m_to", "part").cast("int").alias("part")), "parts")
    return state


def partition_kway(vertices: DataFrame, edges: DataFrame, k: int, imbalance: float = 0.03, rounds: int = 4, small: int = 20, max_levels: int = 30, seed: int = 1) -> DataFrame:
    """v and part (0 to k - 1): parts of at most 1 + ``imbalance`` times the mean size, with few and light edges between them.

    Contraction ends at ``small`` vertices a part, or where handshakes no longer find pairs.
    """
    graph = materialize(edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")).hint("rebalance"), "graph")
    weights = materialize(vertices.select("v").distinct().withColumn("w", F.lit(1).cast("long")).hint("rebalance"), "weights")
    total = n = weights.count()
    most = max(math.ceil(total / k), math.floor((1 + imbalance) * total / k))
    levels = []
    while n > small * k and len(levels) < max_levels:
        pairs = materialize(heavy_edge_matching(graph, weights, max(2.0, 1.5 * total / (small * k)), seed=seed + len(levels)).hint("rebalance"), "pairs")
        merged = weights.join(pairs.select(F.col("v").alias("p_v"), "community"), F.col("v") == F.col("p_v")).groupBy(F.col("community").alias("v")).agg(F.sum("w").alias("w"))
        merged = materialize(merged, "weights")
        fewer = merged.count()
        if fewer > 0.95 * n:
            break
        levels.append((graph, weights, pairs))
        graph, weights, n = materialize(contract(graph, pairs).where("src <> dst"), "graph"), merged, fewer
    parts = refine(graph, materialize(_first_parts(graph, weights, k), "parts"), k, most, rounds, seed)
    for graph, weights, pairs in reversed(levels):
        above = parts.select(F.col("v").alias("a_v"), "part")
        finer = weights.join(pairs.select(F.col("v").alias("p_v"), "community"), F.col("v") == F.col("p_v")).join(above, F.col("community") == F.col("a_v"))
        parts = refine(graph, materialize(finer.select("v", "w", "part"), "parts"), k, most, rounds, seed)
    return parts.select("v", "part")


def partition_quality(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: parts, the weight of links between different ones, the largest part, and that over the mean part."""
    a, b = (parts.select(F.col("v").alias(f"{x}_v"), F.col("part").alias(f"{x}_part")) for x in "ab")
    between = edges.where("src < dst").join(a, F.col("src") == F.col("a_v")).join(b, F.col("dst") == F.col("b_v")).where("a_part <> b_part")
    cut = between.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cut"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("parts"), F.max("n").alias("largest"), (F.max("n") / F.avg("n")).alias("balance")).crossJoin(cut)  # one row each


def separators(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """v and level: the vertices whose removal separates the halves, quarters and so on of numbered parts.

    Level 0 separates parts that differ in the highest of the bits of part numbers, level 1 those that agree in it and
    differ in the next one. The links of a region that cross a level are a bipartite graph; of its covers by all ends
    on one side, all on the other, and the end that more of them have (the lower side's, if equal), the smallest is
    taken. Vertices of a separator take no part below.
    """
    top = parts.agg(F.max("part")).first()[0] or 0
    bits, taken = max(1, int(top).bit_length()), None
    pairs = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "pairs")
    left = parts
    for level in range(bits):
        bit = bits - 1 - level
        a, b = (left.select(F.col("v").alias(f"{x}_v"), F.col("part").alias(f"{x}_part")) for x in "ab")
        low = pairs.join(a, F.col("src") == F.col("a_v")).join(b, F.col("dst") == F.col("b_v"))
        # Each link once, from the half of the lower parts.
        low = low.where((F.shiftright("a_part", bit + 1) == F.shiftright("b_part", bit + 1)) & (F.shiftright("a_part", bit) < F.shiftright("b_part", bit)))
        crossing = materialize(low.select(F.shiftright("a_part", bit + 1).alias("region"), F.col("src").alias("x"), F.col("dst").alias("y")), "crossing")
        dx, dy = (crossing.groupBy(F.col(c).alias(f"d_{c}")).agg(F.count("*").alias(f"n_{c}")) for c in "xy")
        ends = crossing.join(dx, F.col("x") == F.col("d_x")).join(dy, F.col("y") == F.col("d_y"))
        more = F.when(F.col("n_x") >= F.col("n_y"), F.col("x")).otherwise(F.col("y"))
        covers = ends.select("region", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), c.alias("v")) for i, c in enumerate((F.col("x"), F.col("y"), more))))).alias("c")).select("region", "c.kind", "c.v").distinct()
        smallest = covers.groupBy("region", "kind").agg(F.count("*").alias("n")).groupBy(F.col("region").alias("s_region")).agg(F.min(F.struct("n", "kind"))["kind"].alias("s_kind"))
        chosen = covers.join(smallest, (F.col("region") == F.col("s_region")) & (F.col("kind") == F.col("s_kind"))).select("v", F.lit(level).alias("level"))
        chosen = materialize(chosen, "separators")
        taken = chosen if taken is None else taken.union(chosen)
        left = left.join(chosen.select(F.col("v").alias("c_v")), F.col("v") == F.col("c_v"), "left_anti")
    return taken


def dissection_order(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """v, level (of its separator, or -1) and place (from 0): both halves of a region before what separates them, parts in order, ids in order within."""
    cuts = separators(edges, parts).select(F.col("v").alias("c_v"), "level")
    bits = max(1, int(parts.agg(F.max("part")).first()[0] or 0).bit_length())
    held = parts.join(cuts, F.col("v") == F.col("c_v"), "left").select("v", "part", F.coalesce("level", F.lit(-1)).alias("level"))
    # A digit for each level: which half, or 2 for what separates them, which ends the path.
    digits = [F.when(F.col("level") == i, 2).when((F.col("level") >= 0) & (F.col("level") < i), 0).otherwise(F.shiftright("part", bits - 1 - i).bitwiseAND(1)) for i in range(bits)]
    path = F.concat(*(d.cast("string") for d in digits))
    return global_rank(held.withColumn("path", path), [F.col("path"), F.col("v")], "place").select("v", "level", "place")


def nested_dissection(vertices: DataFrame, edges: DataFrame, depth: int = 3, **options) -> DataFrame:
    """``dissection_order`` of a partition into 2 ** ``depth`` parts, whose numbers follow a breadth-first order, so halves of numbers are halves of the graph."""
    return dissection_order(edges, materialize(partition_kway(vertices, edges, 1 << depth, **options), "parts"))
