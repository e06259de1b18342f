"""Folders that all executors share, and files in them.

Lineage is cut by tables written below `spark.checkpoint.dir`; nothing is kept on one machine. Where the session does
not name that folder (tests on local mode), a temporary one is set.
"""

from __future__ import annotations

import ctypes
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new, empty place for `name` in the shared folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    slim(spark)
    path = posixpath.join(_qualified(spark, base), f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


#: Places that this process has given out, but for those that are dropped again.
_MADE: list[str] = []


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Drops at its end the places that were given out within, but for those of the names to keep. What lies in them must
    have been used by then: a plan that still reads them would fail."""
    before = len(_MADE)
    yield
    drop(spark, *[p for p in _MADE[before:] if posixpath.basename(p).rpartition("-")[0] not in keep])


def clear(spark: SparkSession) -> None:
    """Drops all places that this process has given out. For callers that are done with the results: these are read from there."""
    drop(spark, *_MADE)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that Spark's readers and Python's writers mean the same place."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def slim(spark: SparkSession) -> None:
    """Smaller Arrow batches: long texts must not add up to more than a worker's memory. Sessions may set their own."""
    for key, default, own in (("maxRecordsPerBatch", "10000", "512"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


#: Rows of a few numbers up to which a table may be broadcast.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A narrow table, to be broadcast if it has at most SMALL_ROWS rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def put(path: str, content: bytes) -> None:
    """Writes a file as a whole: a task that runs twice, or dies half-way, leaves no torn file."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, at)


def get(path: str) -> bytes:
    """A file's content."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, content) of the files below `path`."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def pieces(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most `rows` rows; what the one before has freed goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            _trim()


def _libc_trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def _trim() -> None:
    """Freed arrays stay with a worker otherwise, and workers outlive their stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _libc_trim()(0)
