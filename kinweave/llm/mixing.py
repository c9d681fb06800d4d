"""Mixing sources to target weights by weighted sampling with exponential keys, in DataFrame functions only.

Sources, in code point order with null last, take the given weights in turn. They share ``epochs_total``
times the size of the corpus by weight; a source's target stops at ``cap`` times its size and the excess
is shared by weight among the others (water filling). Every document is taken once for each complete
epoch in its source's target. What is left is drawn by Efraimidis-Spirakis sampling: a document with
quality weight w and uniform u gets the key -ln(u)/w, and the smallest keys are taken until the prefix
sum of sizes meets the rest of the budget (the document on the edge if at least half of it fits).

u comes from md5 of the id, so reruns agree. No source is sorted in one task: with a source's keys in units of their
mean, x, its rows fall into sqrt(rows) ranges of x / (1 + x). Keys are exponential with rates from 0.05 to 1, so a range has at
most about six times the mean range's rows whatever a source's weights (1.5 times if they are equal). Sizes are
summed for each range first, and only rows of one range are sorted together. Sources are compared in one task, a row each.

Null text has size 0. A null id hashes as "null". Repeated rows have equal keys, and are ordered by id and
size; rows equal in these can be exchanged. Sizes of zero take no words but follow the copies. Extra
columns of documents aren't read, whatever their names. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.rows import whole_row
from kinweave.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
#: Sources whose mean keys are broadcast, a row each; more are joined.
BROADCAST_SOURCES = 100_000
#: Characters that count against a document's quality weight.
_JUNK = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """The share of characters that aren't junk, at least 0.05."""
    kept = F.length(F.translate(text, _JUNK, "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(kept, F.lit(0.05))).otherwise(F.lit(1.0))


def uniform(id: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the id's md5."""
    digits = F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs_total: float, cap: float) -> DataFrame:
    """source, source_size, target: the water level is where the first source, by size per weight, isn't capped."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(epochs_total) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") < F.col("full") / F.col("weight"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("water", water).select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("water") * F.col("weight")), F.col("full")).alias("target"))


def _sized(docs: DataFrame, id: str, text: str, source: str, *more: Column) -> DataFrame:
    """doc_id, source, size and key of each row, and ``more``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        (-F.log(uniform(F.col(id))) / quality_weight(body)).alias("key"),
        *more,
    )


class _Plan:
    """Where the rows of a mix fall: the mean key of each source, and for each range of its keys the words before it and the source's target."""

    def __init__(self, sizes: DataFrame, weights: tuple[int, ...], epochs_total: float, cap: float):
        self.n_ranges = max(1, math.isqrt(sizes.count()))
        means = materialize(sizes.groupBy(F.col("source").alias("k_source")).agg(F.avg("key").alias("mean_key")), "means")
        self.means = F.broadcast(means) if means.count() <= BROADCAST_SOURCES else means
        sums = self._ranged(sizes).groupBy("source", "cell", "range").agg(F.sum("size").alias("range_size"))
        running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(running), F.lit(0)))
        goal = targets(sizes, weights, epochs_total, cap).withColumnRenamed("source", "g_source")
        plan = offsets.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
        self.cells = plan.select(F.col("cell").alias("p_cell"), "offset", "source_size", "target")

    def _ranged(self, rows: DataFrame) -> DataFrame:
        """With range, and cell, one name for the source and the range."""
        unit = F.col("key") / F.col("mean_key")
        place = F.least(F.lit(self.n_ranges - 1), F.floor(F.lit(self.n_ranges) * (unit / (1 + unit)))).cast("long")
        held = rows.join(self.means, F.col("source").eqNullSafe(F.col("k_source"))).withColumn("range", place).drop("k_source", "mean_key")
        return held.withColumn("cell", F.concat_ws("/", "range", "source", F.col("source").isNull().cast("string")))

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source_size, target and how often each is taken. Rows are shuffled once, to the other rows of their cell."""
        joined = self._ranged(rows).join(self.cells, F.col("cell") == F.col("p_cell"))
        within = Window.partitionBy("cell").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
        rest = F.col("target") - epochs * F.col("source_size")
        ahead = F.col("offset") + F.sum("size").over(within) - F.col("size")
        picked = F.when((rest > 0) & (ahead + F.col("size") / 2 <= rest), 1).otherwise(0)
        return joined.withColumn("copies", (epochs + picked).cast("long"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs_total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies and taken words."""
    sizes = materialize(_sized(docs, id, text, source), "mix")
    mixed = _Plan(sizes, weights, epochs_total, cap).copies(sizes)
    return mixed.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs_total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    The plan is made from sizes alone; then each row goes with its columns to the other rows of its range, so
    rows that share their id, or everything, are taken as often as ``mix`` counts them.
    """
    plan = _Plan(materialize(_sized(docs, id, text, source), "mix"), weights, epochs_total, cap)
    names = docs.columns
    taken = plan.copies(_sized(docs, id, text, source, whole_row(docs).alias("row"))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[name].alias(name) for name in names))
