"""Tables that grow by rows: a write appends, and of several rows of one key the last counts when the table is read.

A row carries `ordinal`, the time of its write, so an append reads nothing, rewrites nothing and needs no lock. Each goes to a folder of
its own, as Spark's committer wants one folder for each job; what was not finished lies below `_temporary`, which readers pass over.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Journal:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        now = time.time_ns()
        rows.withColumn("ordinal", F.lit(now)).write.parquet(f"{self.folder}/{table}/{now}-{uuid.uuid4().hex[:8]}")

    def rows(self, table: str, schema: str) -> DataFrame:
        """All rows of all writes, with their `ordinal`; none where nothing was written."""
        schema = f"{schema}, ordinal long"
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last(self, table: str, schema: str, keys: list[str], by_column: bool = False) -> DataFrame:
        """The last row of each key, or `by_column` the last value of each column that is not null, so that a write which lacks a field leaves it as it was."""
        return _merged(self.rows(table, schema), keys, by_column).drop("ordinal")

    def compact(self, table: str, schema: str, keys: list[str], by_column: bool = False) -> None:
        """Puts the last rows of all writes so far into one write, then deletes those. Rows keep their ordinals (by column: the last of
        their key), so rows that are there twice for a while, or for good if this stops half-way, change no result, and what is appended
        meanwhile stays. Readers that have listed the old files must be done."""
        old = self.rows(table, schema)
        files = old.inputFiles()
        if not files:
            return
        own = self.spark.read.schema(old.schema).parquet(*files)
        _merged(own, keys, by_column).write.parquet(f"{self.folder}/{table}/{time.time_ns()}-{uuid.uuid4().hex[:8]}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in files:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, False)


def _merged(rows: DataFrame, keys: list[str], by_column: bool) -> DataFrame:
    """One row for each key, with its last ordinal; both choices combine on the map side."""
    rest = [c for c in rows.columns if c not in (*keys, "ordinal")]
    last = F.max("ordinal").alias("ordinal")
    if by_column:
        # Rows of one write share their ordinal: the larger value counts then.
        chosen = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ordinal", c))).alias(c) for c in rest]
        return rows.groupBy(*keys).agg(*chosen, last).select(*rows.columns)
    if not rest:
        return rows.groupBy(*keys).agg(last).select(*rows.columns)
    whole = F.max_by(F.struct(*rest), F.struct("ordinal", *rest)).alias("_last")
    return rows.groupBy(*keys).agg(whole, last).select(*keys, "_last.*", "ordinal").select(*rows.columns)
