"""Vertex orders that bring neighbours together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from kinweave.operators.components import connected_components
from kinweave.plans.ranking import global_rank
from kinweave.plans.scratch import materialize, scratch_path


def reverse_cuthill_mckee(vertices: DataFrame, edges: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """v, component, level and place (from 0): breadth-first levels from each component's vertex of least degree, by degree and id within a level, reversed.

    One job for each level serves all components, and reads the last two levels; a graph of more than ``max_levels`` levels
    raises an error. ``edges`` are symmetric. The order of the reversed sequence is by component, level,
    degree and id, all descending.
    """
    pairs = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "pairs")
    reached = connected_components(pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("v").alias("r_v"), "component")
    degrees = pairs.groupBy(F.col("src").alias("d_v")).agg(F.count("*").alias("degree"))
    held = vertices.join(reached, F.col("v") == F.col("r_v"), "left").join(degrees, F.col("v") == F.col("d_v"), "left")
    held = materialize(held.select("v", F.coalesce("component", "v").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "vertices")
    starts = held.groupBy("component").agg(F.min_by("v", F.struct("degree", "v")).alias("v"))
    spark, path = vertices.sparkSession, scratch_path(vertices.sparkSession, "levels")
    at = lambda level: spark.read.schema(starts.select("v").schema).parquet(f"{path}/level={level}")
    starts.select("v").write.parquet(f"{path}/level=0")
    for level in range(max_levels):
        # A neighbour of a level is in the level before, the same or the next one.
        ahead = pairs.join(at(level).select(F.col("v").alias("e_v")), F.col("src") == F.col("e_v")).select(F.col("dst").alias("v")).distinct()
        for before in range(max(0, level - 1), level + 1):
            ahead = ahead.join(at(before), "v", "left_anti")
        ahead.write.parquet(f"{path}/level={level + 1}")
        if not at(level + 1).limit(1).count():
            break
    else:
        raise RuntimeError(f"vertices are left after {max_levels} levels")
    seen = spark.read.schema(starts.select("v").schema.add("level", IntegerType())).option("basePath", path).parquet(path)
    both = held.join(seen.withColumnRenamed("v", "l_v"), F.col("v") == F.col("l_v")).select("v", "component", "level", "degree")
    return global_rank(both, [F.col(c).desc() for c in ("component", "level", "degree", "v")], "place").drop("degree")
