"""Rows of vectors, and blocks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of queries.
BLOCK_ROWS = 8192
QUERY_ROWS = 256
#: Blocks that one task goes through, one after another.
GROUP = 4


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", empty: bool = False) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part: id and vector not null, no null or non-finite component; not empty,
    unless `empty` says so."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    least = F.lit(0 if empty else 1)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") >= least) & ~bad).withColumn("dim", F.size("v"))


def salted(df: DataFrame, keys: list[str], rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Deals rows of equal `keys` to blocks of about `rows` rows each; `name` is the block. Also (keys, last), the last
    block of each. df is a stored table: a row's place in it is part of the hash, so rows that are alike part, too."""
    last = df.groupBy(*keys).agg((F.ceil(F.count("*") / rows) - 1).cast("int").alias("last"))
    few = F.broadcast(last) if last.count() <= 10_000 else last
    dealt = df.withColumn("_row", F.xxhash64("vec_id", F.monotonically_increasing_id())).join(few, keys)
    return dealt.withColumn(name, F.pmod("_row", F.col("last") + 1).cast("int")).drop("_row", "last"), last


def groups(queries: DataFrame, keys: list[str], last: DataFrame, size: int = GROUP) -> DataFrame:
    """Each query once for each group of `size` blocks of its keys, with `first` and `final`, the group's blocks."""
    few = F.broadcast(last) if last.count() <= 10_000 else last
    spread = queries.join(few, keys).withColumn("first", F.explode(F.sequence(F.lit(0), "last", F.lit(size))))
    return spread.withColumn("final", F.least(F.col("last"), F.col("first") + size - 1)).drop("last")


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to a partition for each of them, about: their work is not told by their bytes."""
    return df.repartition(max(1, min(df.select(*keys).distinct().count(), 100_000)), *keys)


def stack(column: pd.Series, dim: int) -> np.ndarray:
    """Lists of one length as a two-dimensional array."""
    return np.array(column.tolist(), float).reshape(len(column), dim)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A two-dimensional array of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
