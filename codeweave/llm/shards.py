"""Searches of a table in itself by key: rows of one key meet, in cells of bounded size.

A key with more than `limit` rows is dealt to parts by a hash of the item, and each pair of its parts (and each part with itself)
is a cell of its own, so no task holds more than the members of one part, and the pairs of parts spread over all tasks. Only the keys
beyond the limit are counted out to the others: a table that is broadcast where it is small and joined otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def cells(rows: DataFrame, keys: list[str], item: str, limit: int) -> DataFrame:
    """rows (keys, item and others), with (low, high, asks): each cell's rows lie together in one partition, first those
    that are searched (asks = false), then those that ask. In a cell of low = high every row is searched and asks what came before."""
    hot = shared.kept(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("parts")), "hot-keys")
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(shared.small(hot), keys, "left").withColumn("own", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(item), parts)).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = spread.select(*rows.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("other") < F.col("own")).alias("asks"))
    by = [*keys, "low", "high"]
    return cell.repartition(*by).sortWithinPartitions(*by, "asks", item)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple | None, tuple]]:
    """(cell, row) of all rows, in order: `cell` is None but for the first row of each cell. Cells go on over batches."""
    last = None
    for batch in batches:
        at = zip(*[batch.column(c).to_pylist() for c in (*keys, "low", "high")], strict=True)
        for cell, row in zip(at, zip(*[batch.column(c).to_pylist() for c in (*columns, "asks")], strict=True), strict=True):
            yield (cell if cell != last else None), row
            last = cell
