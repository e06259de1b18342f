"""Which node stands at a line: interval lookup.

Between one start of a file's spans and the next, what may enclose a line stays the same but for spans that end. So a file is read once, in
the order of starts, and gives a state for each start: the spans that are open there, and the last few that start at or above it.
A probe finds its one state by an equality join on buckets of lines, and what it reads of the state is as deep as the
nesting, however many spans the file has. Buckets are of four widths; a state lies in a few of the narrowest that hold it so, and
gaps and the open end of a file cost no more than other lines. States with more than `DEEP` open spans, or with a span of a million lines, are empty:
probes that meet one are joined with all spans above them. So are those of files of at most `FEW` spans, which need no states.

What a table's files tell of its size says little of its rows, less of their pieces, so sides that grow are merged and only those that are counted are broadcast.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import stored
from .traverse import SEEDS, settled

#: Rank of nodes that start above the line but do not enclose it.
NOT_ENCLOSING = 999_999
TOP = 3
#: Open spans beyond which a state is empty, and spans up to which a file needs no states.
DEEP, FEW = 64, 64
#: Bits of a bucket of lines, from the narrowest, and buckets that a state lies in at most where a wider one is left.
WIDTHS, MANY = (6, 12, 18, 24), 64
#: Lengths of the pieces of paths that hints are looked up by.
GRAMS = (8, 4, 2, 1, 0)
_LAST = (1 << 31) - 1

Span = tuple[str, int, int]


def at_line(nodes: DataFrame, probes: DataFrame, top: int = TOP, on: list[str] | None = None, deep: int = DEEP, few: int = FEW) -> DataFrame:
    """(the probes' columns, id, start_line, end_line, span, encloses, rank): the nodes of each probe, best first: the innermost that
    enclose the line, then the nearest that start above it; ties go to the later start, then to the smaller id.

    probes: (probe, line) and either the columns `on`, equal in both tables, or `file_hint`, a part of the path.
    """
    keys = on or ["file_path"]
    asked = (probes if on else stored(matched(nodes, probes), "matched")).where("line IS NOT NULL")
    files = settled(asked.select(*keys).distinct())
    rows = nodes.select(*keys, "id", "start_line", "end_line").where("start_line IS NOT NULL").hint("merge").join(files, keys, "left_semi")
    large = settled(rows.groupBy(*keys).count().where(F.col("count") > few).select(*keys))

    def above(some: DataFrame, spans: DataFrame) -> DataFrame:
        return some.select(*asked.columns).join(spans.hint("merge"), keys).where("start_line <= line").select(*asked.columns, "id", "start_line", "end_line")

    if large.isEmpty():
        pairs = above(asked, rows)
    else:
        own = rows.hint("merge").join(large, keys, "left_semi")
        met = located(states(own, keys, top, deep), asked.hint("merge").join(large, keys, "left_semi"), keys)
        near = met.where("spans IS NOT NULL").select(*asked.columns, F.explode("spans").alias("_n")).select(*asked.columns, "_n.*")
        pairs = near.unionByName(above(met.where("spans IS NULL"), own)).unionByName(above(asked.hint("merge").join(large, keys, "left_anti"), rows))
    encloses = F.coalesce((F.col("end_line") >= F.col("line")) & (F.col("end_line") > F.col("start_line")), F.lit(False))
    span = F.when(encloses, F.col("end_line") - F.col("start_line")).otherwise(NOT_ENCLOSING)
    order = Window.partitionBy("probe").orderBy("span", F.desc("start_line"), "id")
    return pairs.withColumns({"span": span, "encloses": encloses}).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def batch_lookup(nodes: DataFrame, probes: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The best node of each probe; a probe without one keeps its row, with `found` false."""
    best = at_line(nodes, probes, 1, on).select("probe", "id", "span", "encloses")
    return probes.join(best, "probe", "left").withColumn("found", F.col("id").isNotNull())


# --- states of a file -------------------------------------------------------------------------------------------------


def located(kept: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked with the spans of the state that each line is in; lines above the first start are in none."""
    line = F.col("line").cast("long")
    at = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.shiftright(line, w).alias("bucket")) for w in WIDTHS]))
    spread = asked.select(*asked.columns, at.alias("_at")).select(*asked.columns, "_at.width", "_at.bucket")
    return spread.join(kept.hint("merge"), [*keys, "width", "bucket"]).where("line BETWEEN first AND last").select(*asked.columns, "spans")


def states(rows: DataFrame, keys: list[str], top: int = TOP, deep: int = DEEP) -> DataFrame:
    """(keys, width, bucket, first, last, spans) from rows (keys, id, start_line, end_line): for the lines from first to last of a file, the
    spans that may be among the best `top`; null where they are too many. A task reads files one after another and holds the open spans of one."""
    types = dict(rows.dtypes)
    layout = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["width int, bucket long, first int, last int, spans array<struct<id:string,start_line:int,end_line:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("id", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
        tail = [("width", pa.int32()), ("bucket", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("spans", pa.list_(span))]
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([*[(k, first.schema.field(k).type) for k in keys], *tail])
        read = (row for b in itertools.chain([first], batches) for row in zip(*[b.column(c).to_pylist() for c in (*keys, "id", "start_line", "end_line")], strict=True))
        made = _states(read, len(keys), top, deep)
        while some := list(itertools.islice(made, 1000)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    order = [*keys, "start_line", "end_line", "id"]
    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, layout)


def _states(rows: Iterator[tuple], n: int, top: int, deep: int) -> Iterator[tuple]:
    """Rows of `states` from rows sorted by file (the first n columns) and start."""
    for key, own in itertools.groupby(rows, key=lambda r: r[:n]):
        waiting: tuple[int, list[dict] | None] | None = None
        for start, spans in _openings(((r[n], r[n + 1], r[n + 2]) for r in own), top, deep):
            if waiting:
                yield from _placed(key, waiting[0], start - 1, waiting[1])
            waiting = (start, spans)
        if waiting:
            yield from _placed(key, waiting[0], _LAST, waiting[1])


def _openings(spans: Iterator[Span], top: int, deep: int) -> Iterator[tuple[int, list[dict] | None]]:
    """(start, spans of the state) of each start of one file."""
    ends: list[tuple[int, int]] = []
    opened: dict[int, Span] = {}
    long: set[int] = set()
    recent: list[Span] = []
    number = 0
    for start, group in itertools.groupby(spans, key=lambda s: s[1]):
        while ends and ends[0][0] < start:
            gone = heapq.heappop(ends)[1]
            del opened[gone]
            long.discard(gone)
        own: list[Span] = []
        for s in group:
            own = heapq.nsmallest(2 * top - 1, [*own, s], key=lambda x: x[0])
            if s[2] is not None and s[2] > start:
                number += 1
                opened[number] = s
                heapq.heappush(ends, (s[2], number))
                if s[2] - start >= NOT_ENCLOSING:
                    long.add(number)
        # At most top - 1 of the recent ones enclose a line that needs the others.
        recent = (own + recent)[: 2 * top - 1]
        if len(opened) > deep or long:
            yield start, None
        else:
            # What is both open and recent comes once; spans that are equal in all are told apart by number alone.
            listed = list(opened.values())
            listed += [s for s in recent if s[2] is None or s[2] <= s[1] or s[2] < start]
            yield start, [dict(zip(("id", "start_line", "end_line"), s, strict=True)) for s in listed]


def _placed(key: tuple, first: int, last: int, spans: list[dict] | None) -> Iterator[tuple]:
    width = next((w for w in WIDTHS if (last >> w) - (first >> w) < MANY), WIDTHS[-1])
    for bucket in range(first >> width, (last >> width) + 1):
        yield (*key, width, bucket, first, last, spans)


# --- hints ------------------------------------------------------------------------------------------------------------


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of a length, of texts that are as long."""
    if not size:
        return F.array(F.lit(""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def matched(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (file_hint), once for each path of the nodes (`file_path`) that has the hint in it; hints may be of any length.

    Distinct paths are indexed by their pieces of the lengths that the hints call for; a hint is looked up by that of its own pieces
    which the fewest paths have, and compared with those paths alone.
    """
    paths = nodes.select("file_path").where("file_path IS NOT NULL").distinct()
    hints = probes.select("file_hint").where("file_hint IS NOT NULL").distinct()
    size = F.lit(0)
    for g in reversed(GRAMS):
        size = F.when(F.length("file_hint") >= g, g).otherwise(size)
    found = {r["g"]: r["count"] for r in hints.groupBy(size.alias("g")).count().collect()}  # one of each length of pieces
    sizes = sorted(found)
    cut = [(hints.where(size == g), paths.where(F.length("file_path") >= g), g) for g in sizes or [0]]
    asked = _union([h.select("file_hint", F.explode(_pieces(F.col("file_hint"), g)).alias("piece")) for h, _, g in cut])
    index = _union([p.select("file_path", F.explode(_pieces(F.col("file_path"), g)).alias("piece")) for _, p, g in cut])
    pieces = asked.select("piece").distinct()
    postings = index.hint("merge").join(settled(pieces) if sum(found.values()) <= SEEDS else pieces, "piece", "left_semi")
    held = postings.groupBy("piece").agg(F.count("*").alias("n"))
    # A piece that no path has rules its hint out.
    best = asked.join(held.hint("merge"), "piece", "left").groupBy("file_hint").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best")).where("best.n > 0")
    pairs = best.select("file_hint", F.col("best.piece").alias("piece")).join(postings.hint("merge"), "piece").where(F.col("file_path").contains(F.col("file_hint")))
    return probes.join(pairs.select("file_hint", "file_path").hint("merge"), "file_hint")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
