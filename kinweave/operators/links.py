"""Links between rows that share neighbours, and their reduction to undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.functions import shared_neighbours
from kinweave.plans.scratch import materialize


def neighbour_lists(knn: DataFrame) -> DataFrame:
    """id and its array of neighbours from (src, dst); missing (null or NaN) neighbours are left out."""
    return knn.where(F.col("dst").isNotNull() & ~F.isnan(F.col("dst").cast("double"))).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near"))


def jaccard_links(knn: DataFrame) -> DataFrame:
    """src, dst, weight: half the Jaccard overlap of the two rows' neighbourhoods, for each neighbour.

    A row's list, written once, travels once with its own links and once as the lists of its neighbours; lists have at most
    k entries. Links whose overlap is empty have weight 0.
    """
    # Read twice: as a plan, a neighbour search before it would run twice.
    lists = materialize(neighbour_lists(knn), "lists")
    mine = lists.select(F.col("id").alias("src"), F.col("near").alias("a"), F.explode("near").alias("dst"))
    theirs = lists.select(F.col("id").alias("t_id"), F.col("near").alias("b"))
    joined = mine.join(theirs, F.col("dst") == F.col("t_id"), "left").withColumn("b", F.coalesce("b", F.array().cast("array<long>")))
    n = shared_neighbours(F.col("a"), F.col("b"))
    return joined.select("src", "dst", (n / (F.size("a") + F.size("b") - n) / 2).alias("weight"))


def dedup_links(links: DataFrame, order: str | None = None) -> DataFrame:
    """One link for each unordered pair, without empty slots (an id or weight of 0); self-loops stay.

    The first of a pair's links by the column ``order`` wins with its weight; without that column the least
    weight does, which is the same where both directions agree. The smaller id comes first.
    """
    used = links.where((F.col("src") != 0) & (F.col("dst") != 0) & (F.col("weight") != 0))
    weight = F.min_by("weight", order) if order else F.min("weight")
    return used.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(weight.alias("weight")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
