"""Measures of assignments and of pairs of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.functions import pairs_of
from kinweave.operators.graph import relabelled, weighted_degree
from kinweave.plans.ranking import global_rank
from kinweave.plans.scratch import materialize


def community_sums(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """community, inner (weights of edges inside, both ways) and total (degrees)."""
    both = relabelled(edges, assign)
    return both.groupBy(F.col("cs").alias("community")).agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("total"))


def modularity(edges: DataFrame, assign: DataFrame, factor: float = 1.0) -> DataFrame:
    """One row: the share of weight inside communities less the sum of their squared shares of degree; null without weight.

    Shares are of ``factor`` times the whole weight.
    """
    sums = community_sums(edges, assign).agg(F.sum("inner").alias("i"), (F.sum("total") * factor).alias("m2"), F.sum(F.col("total") * F.col("total")).alias("s"))
    return sums.select((F.try_divide("i", "m2") - F.try_divide("s", F.col("m2") * F.col("m2"))).alias("modularity"))


def resistance(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """One row: n_d = n - sum(size**2) / n, r_min = -(2w / n_d) * Q and the modularity with that resistance, 0 but for rounding."""
    sizes = assign.groupBy("community").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    weight = edges.agg(F.sum("weight").alias("w2"))
    held = sizes.crossJoin(weight).crossJoin(modularity(edges, assign))  # one row each
    held = held.withColumn("n_d", F.col("n") - F.col("squares") / F.col("n"))
    held = held.withColumn("r_min", -F.try_divide("w2", "n_d") * F.col("modularity"))
    adjusted = F.try_divide(F.col("w2") * F.col("modularity") + F.col("r_min") * F.col("n_d"), F.col("w2") - F.col("n") * F.col("r_min"))
    return held.select("n_d", "r_min", "modularity", adjusted.alias("adjusted"))


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and how many rows have both."""
    return pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows, and pairs of rows together in both, in a and in b; counted from sizes, not from pairs."""
    cells = contingency(pairs, a, b)
    both = cells.agg(F.sum("n").alias("rows"), F.sum(pairs_of(F.col("n"))).alias("both"))
    in_a = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("in_a"))
    in_b = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("in_b"))
    return both.crossJoin(in_a).crossJoin(in_b)  # one row each


def pair_fscore(pairs: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: true positives, false negatives and false positives over pairs, precision, recall, f_score."""
    held = pair_counts(pairs, truth, found)
    held = held.select(F.col("both").alias("tp"), (F.col("in_a") - F.col("both")).alias("fn"), (F.col("in_b") - F.col("both")).alias("fp"))
    held = held.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return held.withColumn("f_score", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mirkin(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ordered pairs of rows on which the partitions disagree, over the square of the rows."""
    held = pair_counts(pairs, a, b)
    return held.select((2 * (F.col("in_a") + F.col("in_b") - 2 * F.col("both")) / F.nullif(F.col("rows") * F.col("rows"), F.lit(0))).alias("mirkin"))


def gini(assign: DataFrame) -> DataFrame:
    """One row: the Gini coefficient of community sizes."""
    sizes = assign.groupBy("community").agg(F.count("*").alias("x"))
    ranked = global_rank(sizes, [F.col("x"), F.col("community")], "i")
    sums = ranked.agg(F.sum((F.col("i") + 1) * F.col("x")).alias("ix"), F.sum("x").alias("total"), F.count("*").alias("n"))
    return sums.select((F.try_divide(2 * F.col("ix"), F.col("n") * F.col("total")) - F.try_divide(F.col("n") + 1, F.col("n"))).alias("gini"))


def triangles(edges: DataFrame) -> DataFrame:
    """a, b and c, each triangle of symmetric ``edges`` once.

    Edges point from the end of smaller degree (then id) to the other, so a hub has few that leave it: at most the square
    root of twice the edges. Two that leave one vertex make a wedge, and an edge between their ends closes it.
    """
    return _closed(_oriented(edges)).select(F.col("lo").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def _oriented(edges: DataFrame) -> DataFrame:
    """lo, hi and their degrees d_lo, d_hi: each link between different vertices once."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    degrees = plain.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    a, b = (degrees.select(F.col("v").alias(f"{x}_v"), F.col("d").alias(f"d_{x}")) for x in ("lo", "hi"))
    held = plain.join(a, F.col("src") == F.col("lo_v")).join(b, F.col("dst") == F.col("hi_v"))
    return held.where((F.col("d_lo") < F.col("d_hi")) | ((F.col("d_lo") == F.col("d_hi")) & (F.col("src") < F.col("dst")))).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), "d_lo", "d_hi")


def _closed(up: DataFrame) -> DataFrame:
    """lo, x and y of each triangle, in the order of degrees and ids."""
    one, two = (up.select(F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(k), F.col("d_hi").alias(f"d_{k}")) for k in "xy")
    wedges = one.join(two, (F.col("lo_x") == F.col("lo_y")) & ((F.col("d_x") < F.col("d_y")) | ((F.col("d_x") == F.col("d_y")) & (F.col("x") < F.col("y")))))
    ends = up.select(F.col("lo").alias("e_lo"), F.col("hi").alias("e_hi"))
    return wedges.join(ends, (F.col("x") == F.col("e_lo")) & (F.col("y") == F.col("e_hi"))).select(F.col("lo_x").alias("lo"), "x", "y")


def edge_similarity(edges: DataFrame) -> DataFrame:
    """src, dst and the Jaccard overlap of the ends' neighbour sets, for each distinct edge of symmetric ``edges`` that isn't a loop.

    Common neighbours are the triangles of an edge: no array of a hub's neighbours is built, and a star has no wedge.
    """
    up = materialize(_oriented(edges), "oriented")
    sides = F.array(F.struct(F.col("lo").alias("a"), F.col("x").alias("b")), F.struct(F.col("lo").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("y").alias("b")))
    shared = _closed(up).select(F.explode(sides).alias("side")).groupBy(F.col("side.a").alias("s_lo"), F.col("side.b").alias("s_hi")).agg(F.count("*").alias("n"))
    held = up.join(shared, (F.col("lo") == F.col("s_lo")) & (F.col("hi") == F.col("s_hi")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = held.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), (F.col("n") / (F.col("d_lo") + F.col("d_hi") - F.col("n"))).alias("similarity"))
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity"))


def color_conflicts(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: links between different vertices of one colour, each counted once; uncoloured ends don't conflict."""
    a = colors.select(F.col("v").alias("a_v"), F.col("color").alias("ca"))
    b = colors.select(F.col("v").alias("b_v"), F.col("color").alias("cb"))
    pairs = edges.where("src < dst").select("src", "dst").distinct()
    held = pairs.join(a, F.col("src") == F.col("a_v")).join(b, F.col("dst") == F.col("b_v"))
    return held.agg(F.count_if((F.col("ca") == F.col("cb")) & (F.col("ca") >= 0)).alias("conflicts"))


def color_stats(colors: DataFrame) -> DataFrame:
    """One row: number of colours, least, greatest and mean count, and the counts' variance."""
    counts = colors.where("color >= 0").groupBy("color").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_colors"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.var_pop("n").alias("variance"))


__all__ = ["community_sums", "modularity", "resistance", "contingency", "pair_fscore", "mirkin", "gini", "edge_similarity", "color_conflicts", "color_stats", "weighted_degree"]
