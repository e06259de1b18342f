"""Packing documents into windows by non-negative least squares over shallow combinations of lengths.

A document of n tokens is cut into full windows and a remainder. Full windows stand alone. The histogram of the
remainders (one row for each length, `window` at most) goes to the driver, which

1. enumerates shallow combinations of lengths that fill a window exactly: two lengths, up to `DEPTH` equal lengths and
   what completes them, and two lengths of a coarse grid and what completes them;
2. solves min ||A x - h||, x >= 0 for their repeat counts by coordinate descent, and rounds down, never past h;
3. fills greedily: combinations, the most useful first, as often as what is left allows.

What then is left is packed greedily one after another, longest first, and cut where a window is full, so that only
the last window has padding. All remainders of one length are alike, so a document needs no more than its rank among
those of its length to know its place: ranks are counts within each part of the staged table plus the sums of the
parts before it, which each part finds in a file of its own; no group of equal lengths meets in one task, and nothing
that grows with the number of parts is broadcast.

Edge cases: null text counts as empty; an empty text is the end id alone; rows with the same doc_id are packed as
separate documents; null doc_ids stay null; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, gathered

WINDOW = 2048
#: Pieces in a combination, at most.
DEPTH = 8
#: Grid of the combinations of three different lengths, in parts of a window.
GRID = 32
SWEEPS = 60


def combinations(window: int) -> list[dict[int, int]]:
    """{length: times} of the combinations that fill a window exactly."""
    seen: dict[tuple, dict[int, int]] = {}

    def add(*lengths: int) -> None:
        if min(lengths) > 0:
            key = tuple(sorted(lengths))
            seen.setdefault(key, {n: key.count(n) for n in set(key)})

    for a in range(1, window):
        for k in range(1, DEPTH):
            if a * k < window:
                add(*[a] * k, window - a * k)
    step = max(1, window // GRID)
    for a in range(step, window, step):
        for b in range(a + step, window - a, step):
            add(a, b, window - a - b)
    return [seen[k] for k in sorted(seen)]


def solve(patterns: list[dict[int, int]], h: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts >= 0 that bring the patterns' lengths closest to h, in least squares."""
    rest, x = h.astype(float).tolist(), [0.0] * len(patterns)
    columns = [(list(p.items()), float(sum(t * t for t in p.values()))) for p in patterns if all(h[n] for n in p)]
    places = [i for i, p in enumerate(patterns) if all(h[n] for n in p)]
    for _ in range(sweeps):
        moved = 0.0
        for i, (items, norm) in zip(places, columns, strict=True):
            step = max(-x[i], sum(t * rest[n] for n, t in items) / norm)
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, t in items:
                    rest[n] -= t * step
        if moved < 0.05:
            break
    return np.array(x)


def plan(h: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Slots (length, first rank, end of ranks, first window, offset), and how many of each length have a slot."""
    patterns = combinations(window)
    x = solve(patterns, h)
    left, used = h.astype(np.int64).copy(), np.zeros(len(h), np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    windows = 0

    def take(p: dict[int, int], n: int) -> None:
        nonlocal windows
        n = min([n, *(int(left[length]) // t for length, t in p.items())])
        if n <= 0:
            return
        at = 0
        for length, t in sorted(p.items(), reverse=True):
            for _ in range(t):
                slots.append((length, int(used[length]), int(used[length]) + n, windows, at))
                used[length] += n
                at += length
            left[length] -= t * n
        windows += n

    order = np.argsort(-x, kind="stable")
    for i in order:
        take(patterns[i], int(x[i]))
    for i in order:
        take(patterns[i], 1 << 60)
    return slots, used


_STAGED = "pid long, doc_id long, n_tokens long, rem int, rank long, fulls long, full_at long, crcs binary, ids binary"


def _kind(vocabulary: int, end_id: int) -> str:
    """How an id is staged."""
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, window: int):
    """Lengths, sums of the full windows, ids of the remainder; ranks count within this part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = _kind(enc.vocabulary, end_id)
        pid = TaskContext.get().partitionId()
        seen, full_at = np.zeros(window, np.int64), 0
        for batch in shared.pieces(gathered(batches), 1 << 16):
            docs = [np.append(ids, np.uint32(end_id)).astype("<u4") for ids in enc.encode(batch.column(1))]
            n = np.array(list(map(len, docs)), np.int64)
            rem, fulls, ranks = (n % window).astype(np.int32), n // window, np.zeros(len(n), np.int64)
            for i, r in enumerate(rem.tolist()):
                ranks[i] = seen[r]
                seen[r] += 1
            firsts = full_at + np.cumsum(fulls) - fulls
            full_at += int(fulls.sum())
            crcs = [np.array([zlib.crc32(d[a : a + window].tobytes()) for a in range(0, len(d), window)], "<u4").tobytes() for d in docs]
            yield pa.record_batch([pa.array(np.full(len(n), pid)), batch.column(0), pa.array(n), pa.array(rem), pa.array(ranks), pa.array(fulls), pa.array(firsts), pa.array(crcs, pa.binary()), pa.array([d[len(d) - r :].astype(kind).tobytes() for d, r in zip(docs, rem.tolist(), strict=True)], pa.binary())], names=[x.split()[0] for x in _STAGED.split(", ")])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bases(ranks: DataFrame, out: str, window: int) -> None:
    """For each part a file below `out`: how many remainders of each length, and how many full windows (at 0), come
    before it."""

    def put(table: pa.Table) -> pa.Table:
        pid, base = table["pid"][0].as_py(), np.zeros(window, "<i8")
        base[table["rem"].to_numpy()] = table["rank0"].to_numpy()
        base[0] = table["full0"][0].as_py()
        shared.put(f"{out}/{pid}.bin", zlib.compress(base.tobytes(), 1))
        return pa.table({"pid": pa.array([pid], pa.int64())})

    shared.kept(ranks.groupBy("pid").applyInArrow(put, "pid long"), "bases-done")


def _base(out: str, pid: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.get(f"{out}/{pid}.bin")), "<i8")


def _place(bases: str, window: int, slots: list, used: np.ndarray, rest_at: np.ndarray, packed: int, cut_windows: int, kind: str):
    """Pieces of each document. Windows: first those of combinations, then those of what was left, then full ones."""
    by: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {s[0] for s in slots}:
        own = np.array(sorted((s[1:] for s in slots if s[0] == length)), np.int64)
        by[length] = (own[:, 0], own[:, 2], own[:, 3])
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = -1, np.zeros(0, np.int64)
        for batch in shared.pieces(batches, 1024):
            out: list[tuple] = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "n_tokens", "rem", "rank", "fulls", "full_at")), batch.column("crcs"), batch.column("ids"), strict=True):
                pid, doc, n, rem, rank, fulls, full_at, crcs, ids = r
                if pid != part:
                    part, base = pid, _base(bases, pid)
                rank, full_at = rank + int(base[rem]), full_at + int(base[0])
                sums = np.frombuffer(crcs.as_buffer(), "<u4").tolist()
                for k in range(fulls):
                    out.append((doc, k * window, window, sums[k], n, packed + cut_windows + full_at + k, 0))
                if not rem:
                    continue
                start = fulls * window
                if rank < used[rem]:
                    ranks, first, offset = by[rem]
                    s = int(np.searchsorted(ranks, rank, "right")) - 1
                    out.append((doc, start, rem, sums[-1], n, int(first[s]) + rank - int(ranks[s]), int(offset[s])))
                    continue
                at = int(rest_at[rem]) + (rank - int(used[rem])) * rem
                raw, done = memoryview(np.frombuffer(ids.as_buffer(), kind).astype("<u4").tobytes()), 0
                while done < rem:
                    w, o = divmod(at + done, window)
                    size = min(rem - done, window - o)
                    out.append((doc, start + done, size, zlib.crc32(raw[4 * done : 4 * (done + size)]), n, packed + w, o))
                    done += size
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each document (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged, _ = shared.stored(rows.mapInArrow(_tokenize(tokenizer, end_id, window), _STAGED), "ids")
    parts = shared.kept(staged.groupBy("pid", "rem").agg(F.count("*").alias("n"), F.sum("fulls").alias("fulls")), "parts")
    h = np.zeros(window, np.int64)
    for r in parts.groupBy("rem").agg(F.sum("n").alias("n")).collect():  # `window` rows at most
        h[r["rem"]] = r["n"]
    h[0] = 0
    slots, used = plan(h, window)
    left = h - used
    lengths = np.arange(window)[::-1]
    ends = np.cumsum(left[lengths] * lengths)
    rest_at = np.zeros(window, np.int64)
    rest_at[lengths] = ends - left[lengths] * lengths
    packed = max((s[3] + s[2] - s[1] for s in slots), default=0)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    fulls = parts.groupBy("pid").agg(F.sum("fulls").alias("fulls")).select("pid", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("full0"))  # a row for each part
    ranked = parts.select("pid", "rem", "n", F.coalesce(F.sum("n").over(before.partitionBy("rem")), F.lit(0)).alias("rank0"))
    ranks = shared.kept(ranked.join(fulls, "pid"), "ranks")
    bases = shared.folder(docs.sparkSession, "bases")
    _bases(ranks, bases, window)
    # What is left has the last ranks, and so lies in the last parts: ids are read of those alone.
    uses = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(used)], "rem int, used long")
    cut = ranks.where("rem > 0").join(F.broadcast(uses), "rem").where("rank0 + n > used").agg(F.min("pid")).first()[0]
    cut = (1 << 62) if cut is None else cut
    columns = ["pid", "doc_id", "n_tokens", "rem", "rank", "fulls", "full_at", "crcs"]
    place = _place(bases, window, slots, used, rest_at, packed, -(-int(ends[-1]) // window), _kind(encoder(tokenizer).vocabulary, end_id))

    def placed(part: DataFrame) -> DataFrame:
        return part.mapInArrow(place, _PIECES)

    return placed(staged.where(F.col("pid") < cut).select(*columns, F.lit(None).cast("binary").alias("ids"))).unionAll(placed(staged.where(F.col("pid") >= cut).select(*columns, "ids")))
