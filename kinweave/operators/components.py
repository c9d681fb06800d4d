"""Connected components of an undirected graph by alternating large and small stars.

Every round replaces edges by stars around smaller ids; the number of edges never grows, and rounds are
about logarithmic in the longest path. Loop state goes through the shared folder, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.plans.scratch import Rotation


def _with_least(sym: DataFrame) -> DataFrame:
    """Rows (u, v) with ``m``, the least of u and all its v."""
    least = sym.groupBy(F.col("u").alias("mu")).agg(F.min("v").alias("m"))
    return sym.join(least, F.col("u") == F.col("mu")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(sym).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _with_least(down)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` has ids u and v; the result has a row (v, component) for each id that isn't its component's least.

    Self-loops, repeats and both directions of an edge may occur; edges with a null end are ignored.
    """
    state = edges.select("u", "v").where("u <> v").distinct()
    held, rotation = None, Rotation(edges.sparkSession, "stars")
    for _ in range(max_rounds):
        state = rotation.write(_small_star(_large_star(state)))
        seen = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == held:
            break
        held = tuple(seen)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return state.select(F.col("u").alias("v"), F.col("v").alias("component"))
