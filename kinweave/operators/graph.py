"""Graphs as symmetric edge tables (src, dst, weight) and their transforms.

Each undirected link is an edge in both directions; a self-loop link is two equal edges. Assignments
have v and community, -1 for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.components import connected_components
from kinweave.plans.ranking import global_rank, place_in_group


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def build_graph(links: DataFrame) -> DataFrame:
    """Edges in both directions; self-loops twice."""
    links = links.select("src", "dst", "weight")
    return links.unionAll(swapped(links))


def to_undirected(arcs: DataFrame) -> DataFrame:
    """Edges of arcs given in one or both directions: those with src >= dst, and their mirror; loops once."""
    down = arcs.where("src >= dst").select("src", "dst", "weight")
    return down.unionAll(swapped(down.where("src > dst")))


def remove_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Without self-loops; of repeats of (src, dst) the first by ``order``, or else the least weight, stays."""
    weight = F.min_by("weight", order) if order else F.min("weight")
    return edges.where("src <> dst").groupBy("src", "dst").agg(weight.alias("weight"))


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """v, its degree in edges, and its neighbours in order."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("dst")).alias("neighbours"))


def adjacency_chunks(edges: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """v, chunk (from 0), n and neighbours: a vertex's neighbours in order, in chunks of at most ``chunk_rows``, so that no array has all those of a hub."""
    placed = place_in_group(edges.select(F.col("src").alias("v"), "dst"), "v", [F.col("dst")], "place", "degree")
    chunk = F.floor(F.col("place") / chunk_rows).alias("chunk")
    return placed.groupBy("v", chunk).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("dst")).alias("neighbours"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """v and the sum of its edges' weights."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sum("weight").alias("degree"))


def total_weight(edges: DataFrame) -> DataFrame:
    """The sum of all degrees and its inverse."""
    total = edges.agg(F.sum("weight").alias("total"))
    return total.select("total", F.try_divide(F.lit(1.0), F.col("total")).alias("inverse"))


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, greatest and mean degree (in edges), its variance and deviation, isolated and degree-1 vertices, density."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("n"))
    held = vertices.join(degrees, F.col("v") == F.col("src"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    one = held.agg(
        F.count("*").alias("n_vertices"), (F.sum("n") / 2).alias("n_edges"), F.max("n").alias("max_degree"), F.avg("n").alias("avg_degree"), F.var_pop("n").alias("var_degree"),
        F.stddev_pop("n").alias("std_degree"), F.count_if(F.col("n") == 0).alias("isolated"), F.count_if(F.col("n") == 1).alias("degree_one"),
    )
    return one.withColumn("density", F.try_divide(2 * F.col("n_edges"), F.col("n_vertices") * (F.col("n_vertices") - 1)))


def vertex_following(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """v and the community that it starts in: a vertex with one edge joins its neighbour if that has more edges or a smaller id; isolated ones get -1."""
    own = edges.groupBy(F.col("src").alias("f_v")).agg(F.count("*").alias("n"), F.min("dst").alias("only"))
    other = own.select(F.col("f_v").alias("o_v"), F.col("n").alias("o_n"))
    held = vertices.join(own, F.col("v") == F.col("f_v"), "left").join(other, F.col("only") == F.col("o_v"), "left")
    follows = (F.col("n") == 1) & ((F.col("o_n") > 1) | (F.col("v") > F.col("only")))
    return held.select("v", F.when(F.col("n").isNull(), F.lit(-1).cast("long")).when(follows, F.col("only")).otherwise(F.col("v")).alias("community"))


def relabelled(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges with the communities of both ends as cs and ct."""
    a = assign.select(F.col("v").alias("a_v"), F.col("community").alias("cs"))
    b = assign.select(F.col("v").alias("b_v"), F.col("community").alias("ct"))
    return edges.join(a, F.col("src") == F.col("a_v")).join(b, F.col("dst") == F.col("b_v")).select("src", "dst", "weight", "cs", "ct")


def contract(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges between communities with summed weights; weights stay doubles."""
    return relabelled(edges, assign).groupBy(F.col("cs").alias("src"), F.col("ct").alias("dst")).agg(F.sum("weight").alias("weight"))


def coarsen(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """The next level's graph: as ``contract``, and every community has a self-loop, of weight 0 if it has no inner edge.

    Inner edges count from both ends in one self-loop, so degrees are kept.
    """
    loops = assign.where("community >= 0").select(F.col("community").alias("src"), F.col("community").alias("dst"), F.lit(0.0).alias("weight")).distinct()
    return contract(edges, assign).unionAll(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def renumber(assign: DataFrame) -> DataFrame:
    """v and dense community numbers from 0 in order of their first vertex; negative ones stay."""
    firsts = assign.where("community >= 0").groupBy(F.col("community").alias("r_community")).agg(F.min("v").alias("first"))
    ranked = global_rank(firsts, [F.col("first")], "number")
    return assign.join(ranked, F.col("community") == F.col("r_community"), "left").select("v", F.coalesce("number", "community").alias("community"))


def compose(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """The community in ``inner`` of each vertex's community in ``outer``; -1 stays."""
    to = inner.select(F.col("v").alias("i_v"), F.col("community").alias("i_community"))
    return outer.join(to, F.col("community") == F.col("i_v"), "left").select("v", F.coalesce("i_community", F.when(F.col("community") < 0, F.col("community"))).alias("community"))


def edges_by_attr(edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """Edges whose ends have the same attribute; ``attrs`` has v and attr."""
    a = attrs.select(F.col("v").alias("a_v"), F.col("attr").alias("a_attr"))
    b = attrs.select(F.col("v").alias("b_v"), F.col("attr").alias("b_attr"))
    return edges.join(a, F.col("src") == F.col("a_v")).join(b, (F.col("dst") == F.col("b_v")) & (F.col("a_attr") == F.col("b_attr"))).select("src", "dst", "weight")


def attr_components(vertices: DataFrame, edges: DataFrame, attrs: DataFrame) -> DataFrame:
    """v and the least vertex that it reaches through edges whose ends have the same attribute."""
    same = edges_by_attr(edges, attrs)
    reached = connected_components(same.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("v").alias("r_v"), "component")
    return vertices.join(reached, F.col("v") == F.col("r_v"), "left").select("v", F.coalesce("component", "v").alias("component"))


def community_order(assign: DataFrame) -> DataFrame:
    """v, community and the vertex's place (from 0) when vertices are grouped by community, -1 last."""
    return global_rank(assign.select("v", "community"), [F.col("community") < 0, F.col("community"), F.col("v")], "place")


def sparsify(edges: DataFrame, similarity: DataFrame, alpha: float = 0.5) -> DataFrame:
    """For each vertex its round(degree ** alpha) most similar edges; ties go to the smaller neighbour. ``similarity`` has src, dst and similarity.

    An edge's place among its vertex's is found by ranges, so a hub's edges are never sorted in one task.
    """
    joined = edges.select("src", "dst", "weight").join(similarity.select(F.col("src").alias("s"), F.col("dst").alias("d"), "similarity"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")))
    placed = place_in_group(joined.select("src", "dst", "weight", "similarity"), "src", [F.col("similarity").desc(), F.col("dst")], "place", "degree")
    return placed.where(F.col("place") < F.round(F.pow("degree", F.lit(alpha)))).select("src", "dst", "weight", "similarity")
