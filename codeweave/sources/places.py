"""Folders that the driver and all executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that `spark.checkpoint.dir` names; a temporary one on a session of a single machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to some tasks for each core. A table of few bytes is read by one task, however much is made of each of its rows."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


#: Rows that a task groups or merges, about.
TASK_ROWS = 250_000


def parts_of(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions for the rows of a table, counted: in proportion to them, two for each core at least. With a fixed number, what a task holds
    would grow with the table."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what comes after starts from there."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
