"""Graph files to and from edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_EDGE = "src long, dst long, weight double"


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#", weighted: bool = True) -> DataFrame:
    """src, dst and weight (1 where there is none) from delimited lines; lines that begin with ``comment`` are skipped."""
    schema = _EDGE if weighted else "src long, dst long"
    rows = spark.read.csv(path, sep=sep, comment=comment, schema=schema)
    return rows.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight") if weighted else F.lit(1.0).alias("weight"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """id (from 1, in order of ``id`` in the first column) and features from delimited numeric lines whose first column is the id."""
    rows = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    first, *rest = rows.columns
    return rows.select(F.col(f"`{first}`").cast("long").alias("id"), F.array(*(F.col(f"`{c}`").cast("double") for c in rest)).alias("features"))


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Arcs of a shortest-path challenge file: lines "a src dst weight"."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("a "))
    return rows.select(parts[1].cast("long").alias("src"), parts[2].cast("long").alias("dst"), parts[3].cast("double").alias("weight"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a coordinate matrix as edges (pattern entries weigh 1).

    The first line after the comments holds the sizes and is left out; entries that read the same stay. Entries of a matrix whose
    header says symmetric or skew-symmetric are mirrored, except those on the diagonal, with the sign turned for the latter.
    """
    text = spark.read.text(path)
    header = text.where(F.col("value").startswith("%%MatrixMarket")).first()
    kind = header["value"].lower().split()[-1] if header else "general"
    lines = text.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    sizes = lines.first()
    if sizes is None:
        return spark.createDataFrame([], _EDGE)
    alike = lines.where(F.col("value") == sizes["value"])
    rows = lines.where(F.col("value") != sizes["value"]).union(alike.limit(alike.count() - 1))
    parts = F.split(F.trim("value"), r"\s+")
    entries = rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
    if kind not in ("symmetric", "skew-symmetric"):
        return entries
    sign = F.lit(1.0 if kind == "symmetric" else -1.0)
    return entries.union(entries.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * sign).alias("weight")))


def read_pajek(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a Pajek network file: lines "src dst [weight]" (1 where there is none) below *Arcs, and both directions of those below *Edges.

    Sections are told apart by the places of their headings, of which a file has a few.
    """
    text = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("place"))
    headings = text.where(F.col("value").startswith("*")).orderBy("place").collect()
    ends = [r["place"] for r in headings[1:]] + [(1 << 63) - 1]
    found = spark.createDataFrame([], _EDGE)
    parts = F.split("value", r"\s+")
    for heading, end in zip(headings, ends):
        kind = heading["value"].lower().split()[0]
        if kind not in ("*arcs", "*edges"):
            continue
        rows = text.where((F.col("place") > heading["place"]) & (F.col("place") < end) & F.col("value").rlike("^[0-9]"))
        arcs = rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
        found = found.union(arcs)
        if kind == "*edges":
            found = found.union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return found


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """v and community (its least member) from lines of blank-separated members; a vertex of several lines has a row for each."""
    members = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("long"))
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(members.alias("members"))
    return rows.select(F.explode("members").alias("v"), F.array_min("members").alias("community"))


def write_matrix_market(edges: DataFrame, path: str) -> None:
    """One coordinate file in the folder ``path``; the format has its sizes at the top, so one task writes all lines, a row at a time."""
    sizes = edges.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")), F.lit(0)).alias("n"), F.count("*").alias("entries"))
    top = sizes.select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate real general"), F.concat_ws(" ", "n", "n", "entries"))).alias("line"))
    top.coalesce(1).union(edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("line"))).coalesce(1).write.text(path)


def write_edge_list(edges: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited lines of src, dst and weight."""
    edges.select("src", "dst", "weight").write.csv(path, sep=sep)


def write_assignment(assign: DataFrame, path: str) -> None:
    """v and community as Parquet."""
    assign.select("v", "community").write.parquet(path)


def edge_lines(edges: DataFrame, sep: str = "\t") -> DataFrame:
    """One text line for each edge."""
    return edges.select(F.concat_ws(sep, "src", "dst", F.round("weight", 9)).alias("line"))
