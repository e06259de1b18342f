"""The graph as Parquet below one folder, each table in parts that are replaced as wholes.

`nodes`, `edges`, `embeddings` and the full-text index (`postings`, `corpora`) have a part for each repository, so indexing one writes nothing of the others; other tables are one part.
A part is a folder of numbered states, of which the newest complete one counts: readers see the old state until the new one is there.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

ALL = "all"


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def _state(self, table: str, part: str) -> str | None:
        """The folder of a part's newest complete state."""
        fs, path = self._fs()
        top = f"{self.folder}/{table}/{part}"
        done = [n for n in self._names(top) if fs.exists(path(f"{top}/{n}/_SUCCESS"))]
        return f"{top}/{done[-1]}" if done else None

    def read(self, table: str, schema: str, part: str | None = None) -> DataFrame:
        """A table, or one part of it."""
        parts = self._names(f"{self.folder}/{table}") if part is None else [_folder(part)]
        at = [s for s in (self._state(table, p) for p in parts) if s]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame, part: str = ALL) -> None:
        """Replaces a part; the state before goes once the new one is complete."""
        fs, path = self._fs()
        name = _folder(part)
        old = self._state(table, name)
        number = int(old.rpartition("/")[2].split("-")[0]) + 1 if old else 0
        df.write.parquet(f"{self.folder}/{table}/{name}/{number:09d}-{uuid.uuid4().hex[:8]}")
        if old:
            fs.delete(path(old), True)

    def drop(self, table: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.folder}/{table}"), True)


def _folder(part: str) -> str:
    """A part's name as a folder's; names of hidden files would not be read."""
    return "p-" + quote(part, safe="")
