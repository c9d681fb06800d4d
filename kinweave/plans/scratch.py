"""Tables written once to the shared folder and read back.

Iterative plans and results that are read twice go through :func:`materialize`. Unlike a local
checkpoint the files live in ``spark.checkpoint.dir``, so losing an executor loses nothing, and the
table read back has fresh statistics and a short plan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/kinweave-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of the columns ``folders``, and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, partitionBy=folders)
    return spark.read.schema(df.schema).parquet(path)


class Rotation:
    """State of a loop, written in turn to two places, so that a loop of any length holds two tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, [scratch_path(spark, name) for _ in range(2)]

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df``, which may read the last state but none before it, and return the table read back."""
        self.paths.reverse()
        df.write.mode("overwrite").parquet(self.paths[0])
        return self.spark.read.schema(df.schema).parquet(self.paths[0])


    def observed(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """``write``, and aggregates of the rows that its tasks wrote."""
        seen = Observation()
        table = self.write(df.observe(seen, *(c.alias(name) for name, c in sums.items())))
        return table, seen.get


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of the column ``text``, as they are and not as files compress them."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
