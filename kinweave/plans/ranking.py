"""Global ranks without a single task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.plans.scratch import materialize, shuffle_partitions


def global_rank(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``keys``.

    Rows are dealt to partitions by ranges of the keys and written; the partitions' counts, at most one
    row for each, give the place of each partition's first row, and rows are ranked within partitions.
    """
    dealt = materialize(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("rank_part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for row in dealt.groupBy("rank_part").agg(F.count("*").alias("n")).orderBy("rank_part").collect():
        offsets.append((row["rank_part"], before))
        before += row["n"]
    first = df.sparkSession.createDataFrame(offsets, "rank_in int, rank_first long")
    inner = F.row_number().over(Window.partitionBy("rank_part").orderBy(*keys)) - 1
    ranked = dealt.withColumn("rank_inner", inner).join(F.broadcast(first), F.col("rank_part") == F.col("rank_in"))
    return ranked.select(*df.columns, (F.col("rank_first") + F.col("rank_inner")).alias(name))


def running_sum(df: DataFrame, group: str, keys: list[Column], value: Column, before: str, whole: str) -> DataFrame:
    """``df`` with the sums of ``value`` (a column or expression) over the rows before each in its group, by the order of ``keys``, and over all of the group.

    Rows are dealt by ranges of group and keys, so a group of any size is spread; a sum for each group of a range gives
    what is before its first row there. Rows of a null group are left out.
    """
    spark = df.sparkSession
    dealt = df.where(F.col(group).isNotNull()).withColumn("rank_value", value).repartitionByRange(shuffle_partitions(spark), F.col(group), *keys)
    dealt = materialize(dealt.withColumn("rank_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(F.col(group).alias("rank_group"), F.col("rank_part").alias("rank_in")).agg(F.sum("rank_value").alias("rank_n"))
    of_group = Window.partitionBy("rank_group")
    earlier = F.sum("rank_n").over(of_group.orderBy("rank_in").rowsBetween(Window.unboundedPreceding, -1))
    first = sums.select("rank_group", "rank_in", F.coalesce(earlier, F.lit(0)).alias("rank_first"), F.sum("rank_n").over(of_group).alias(whole))
    inner = F.sum("rank_value").over(Window.partitionBy(group, "rank_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    ranked = dealt.withColumn("rank_inner", F.coalesce(inner, F.lit(0))).join(first, (F.col(group) == F.col("rank_group")) & (F.col("rank_part") == F.col("rank_in")))
    return ranked.select(*df.columns, (F.col("rank_first") + F.col("rank_inner")).alias(before), whole)


def place_in_group(df: DataFrame, group: str, keys: list[Column], place: str, size: str) -> DataFrame:
    """``df`` with each row's place (from 0) in its group by the order of ``keys``, and the rows of its group."""
    return running_sum(df, group, keys, F.lit(1).cast("long"), place, size)
