"""Merkle manifest of a data set: a digest for each row, trees of them for each group, and inclusion proofs.

A leaf is the SHA-256 of a row's fields, each as its length in UTF-8 bytes, a colon and its value, or "-" if it is
null; digests are lowercase hex text everywhere. Within a group leaves stand in order of the order column. While a
group has several nodes, each run of ``fanout`` consecutive ones (the last may be shorter, even one) becomes the hash
of their concatenation. What remains is the group's subroot, and the subroots in order of the group make the root in
the same way.

A level is one window over (group, parent index): its ordered, full-frame list of nodes is the parent's preimage and
holds the siblings of each node. One row of each run goes on to the next level, with that list, so siblings come back
down by a join of a level with the one above it. Groups are placed by ranges of (group, order, leaf), so a group
of any size is spread over tasks; only digests are shuffled, never text.

Null groups come first, and so do null values of the order column. Rows equal in group and order are in order of
their leaves; rows equal in these too are the same leaf. Empty fields are "0:". An empty table has no rows and no
root. Columns that aren't named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.plans.scratch import materialize, shuffle_partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
_STEPS = "array<struct<before:string,after:string>>"


def named(name: str) -> Column:
    """The column of that very name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as part of a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _place(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (g, keys and others) with idx, the place from 0 within g by the keys, and n, the rows of g.

    Rows are dealt by ranges and written; counts of each range and g, no more than ranges and groups together, give
    the first place of each, and only rows of one range are sorted together. Rows equal in all keys can be split.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col("g").asc_nulls_first(), *order, "tie").drop("tie")
    dealt = materialize(ranged.withColumn("part", F.spark_partition_id()), "manifest")
    counts = dealt.groupBy(F.col("g").alias("c_g"), F.col("part").alias("c_part")).agg(F.count("*").alias("c"))
    by_group = Window.partitionBy("c_g")
    first = F.sum("c").over(by_group.orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1))
    plan = counts.select("c_g", "c_part", F.coalesce(first, F.lit(0)).alias("first"), F.sum("c").over(by_group).alias("n"))
    inner = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    joined = dealt.withColumn("inner", inner).join(plan, F.col("g").eqNullSafe(F.col("c_g")) & (F.col("part") == F.col("c_part")))
    return joined.select(*rows.columns, (F.col("first") + F.col("inner")).alias("idx"), "n")


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels over ``nodes`` (g, idx, n, node), lowest first: each has g, idx, n, node and the list of the nodes below; n is what its group has."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parent = F.floor(F.col("idx") / fanout)
        run = Window.partitionBy("g", parent).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = nodes.where("n > 1").select("g", "idx", "n", F.collect_list("node").over(run).alias("below")).where(F.col("idx") % fanout == 0)
        above = runs.select("g", (F.col("idx") / fanout).cast("long").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("below", "").cast("binary"), 256).alias("node"), "below")
        nodes = materialize(above, "level")
        out.append(nodes)
        most = -(-most // fanout)
    return out


def _above(nodes: DataFrame, upper: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` of groups that go on, with top and their steps: the siblings before and after at this level, then those above it."""
    up = upper.select(F.col("g").alias("u_g"), F.col("idx").alias("u_idx"), F.col("below").alias("u_below"), F.col("steps").alias("u_steps"), "top")
    place = (F.col("idx") % fanout).cast("int")
    before, after = F.slice("u_below", F.lit(1), place), F.slice("u_below", place + 2, F.lit(fanout))
    step = F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
    held = nodes.where("n > 1").join(up, F.col("g").eqNullSafe(F.col("u_g")) & (F.floor(F.col("idx") / fanout) == F.col("u_idx")))
    return held.select(*nodes.columns, F.concat(step, "u_steps").alias("steps"), "top")


def _climb(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with steps up to the top of their group and on; ``tops`` has t_g, t_steps and top for each group."""

    def ended(level: DataFrame) -> DataFrame:
        return level.where("n = 1").join(tops, F.col("g").eqNullSafe(F.col("t_g"))).select(*level.columns, F.col("t_steps").alias("steps"), "top")

    upper = None
    for level in reversed(levels):
        done = ended(level)
        upper = done if upper is None else done.union(_above(level, upper, fanout))
    return ended(nodes) if upper is None else ended(nodes).union(_above(nodes, upper, fanout))


def fold(start: Column, steps: Column) -> Column:
    """The digest that a leaf and its siblings on the way lead to."""
    return F.aggregate(steps, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT, changed: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: g, order, leaf, changed_leaf, idx (place in its group), subroot, root, and steps, the siblings before and after it at each level up to the root.

    ``changed`` replaces fields by other columns, for changed_leaf only: what the leaf would be if they were so.
    """
    leaf = digest(*(field(named(f)) for f in fields))
    other = digest(*(field((changed or {}).get(f, named(f))) for f in fields)) if changed else F.lit(None).cast("string")
    rows = docs.select(named(group).cast("string").alias("g"), named(order).alias("order"), leaf.alias("node"), other.alias("other"))
    # The changed leaf is kept where it differs.
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("node"), F.col("other")))
    leaves = materialize(_place(rows, ["order", "node", "other"]), "leaves")
    levels = _levels(leaves.select("g", "idx", "n", "node"), fanout)
    subroots = [x.where("n = 1").select("g", "node") for x in (leaves, *levels)]
    held = subroots[0]
    for more in subroots[1:]:
        held = held.union(more)
    by_group = _place(held.select(F.lit(0).alias("g"), F.col("g").alias("name"), "node"), ["name"])
    by_group = materialize(by_group, "subroots")
    upper = _levels(by_group.select("g", "idx", "n", "node"), fanout)
    root = by_group.where("n = 1").select("node")
    for level in upper:
        root = root.union(level.where("n = 1").select("node"))
    whole = root.select(F.lit(0).alias("t_g"), F.array().cast(_STEPS).alias("t_steps"), F.col("node").alias("top"))
    tops = _climb(by_group, upper, whole, fanout)
    tops = materialize(tops.select(F.col("name").alias("t_g"), F.col("steps").alias("t_steps"), F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top")), "tops")
    found = _climb(leaves, levels, tops, fanout)
    return found.select("g", "order", F.col("node").alias("leaf"), F.coalesce("other", "node").alias("changed_leaf"), "idx", F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "steps")


def proof(steps: Column) -> Column:
    """All siblings as one text, level by level and left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")
