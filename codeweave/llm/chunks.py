"""Texts in chunks, and questions about keys that all chunks ask of all others.

`cut` writes the documents once, as rows of about `CHUNK_BYTES` of text each. From then on a chunk is the unit of
work: it can be read again, by any executor, and gives the same keys in the same order. `ask` sends each chunk's distinct keys,
sorted and packed, to the part that has their range of hashes; the part sees a key's occurrences in all chunks,
answers with one small number for each key and chunk, and the answers of `PACK` chunks become one file in the shared folder,
which the chunks' next pass reads. So what moves is a few bytes for each distinct key of a chunk, and no part holds more than
about `PART_KEYS` keys times their spread over chunks.

Chunks and parts both grow with the corpus, so a chunk's share of one part shrinks. Where it would fall below `FEW` keys on the
mean, the exchange has two steps: chunks send to few wide ranges, there `BUNDLE` chunks' keys of one range are merged to a bundle,
and bundles ask the parts as chunks do. A key that all chunks have so reaches its part once for each bundle.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CHUNK_BYTES = 2 << 20
PART_KEYS = 1 << 20
#: Chunks whose answers share a file.
PACK = 16
#: Keys of a chunk for one part, on the mean, below which the exchange has two steps; and chunks of a bundle.
FEW, BUNDLE = 64, 1024

CHUNK_SCHEMA = "chunk long, n_words long, ids array<long>, texts array<string>"
_PA = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


def cut(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of docs (doc_id, text); a null text counts as empty. n_words is about the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        held = words = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, ids, texts, held, words
            out = pa.record_batch([pa.array([chunk]), pa.array([words]), pa.array([ids], _PA[2].type), pa.array([texts], _PA[3].type)], schema=_PA)
            chunk, ids, texts, held, words = chunk + 1, [], [], 0, 0
            return out

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                ids.append(doc)
                texts.append(text)
                held += len(text) + 16
                words += text.count(" ") + text.count("\n") + 1
                if held >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    shared.slim(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.kept(rows.mapInArrow(run, CHUNK_SCHEMA), "chunks")


def parts_for(keys: int, spark) -> int:
    """How many parts share the keys: more with more keys, and enough for all tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // PART_KEYS))


#: A level of compression that costs little.
_LEVEL = 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct keys as their differences, byte by byte."""
    deltas = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    top = 8
    while top > 1 and not planes[top - 1].any():
        top -= 1
    return bytes([top]) + b"".join(p.tobytes() for p in planes[:top])


def unpack_keys(data: bytes | memoryview) -> np.ndarray:
    top = data[0]
    n = (len(data) - 1) // top
    planes = np.zeros((8, n), np.uint8)
    planes[:top] = np.frombuffer(data, np.uint8, top * n, 1).reshape(top, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel()).astype(np.uint64)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def shares(keys: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts that have some of the ascending keys of so many bits, and where the keys of each begin and end."""
    high = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    part = (high * np.uint64(parts)) >> np.uint64(32)
    new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return part[new].astype(np.int32), new, np.append(new[1:], len(keys)).astype(np.int64)[: len(new)]


@dataclass(frozen=True)
class Question:
    """What chunks ask about their keys. Each method is a plain function of arrays.

    `keys_of(row)`: ascending distinct keys below 2**bits of a chunk's row, and an array of each dtype in `payload` beside
    them. `answer(keys, payloads)`: for the keys that one part has of several chunks, a uint8 array for each chunk.
    `merge(keys, payloads)`: those of several chunks as if they were one. `spread(answer, merged, keys, payloads)`: what
    the answer to the merged keys is for each chunk.
    """

    payload: list[str]
    bits: int
    keys_of: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]]
    answer: Callable[[list[np.ndarray], list[list[np.ndarray]]], list[np.ndarray]]
    merge: Callable[[list[np.ndarray], list[list[np.ndarray]]], tuple[np.ndarray, list[np.ndarray]]]
    spread: Callable[[np.ndarray, tuple[np.ndarray, list[np.ndarray]], list[np.ndarray], list[list[np.ndarray]]], list[np.ndarray]]

    def pack(self, keys: np.ndarray, beside: list[np.ndarray]) -> bytes:
        plain = pack_keys(keys)
        return squeeze(len(plain).to_bytes(8, "little") + plain + b"".join(x.astype(t).tobytes() for x, t in zip(beside, self.payload, strict=True)))

    def unpack(self, blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        data = expand(blob)
        size = int.from_bytes(data[:8], "little")
        keys = unpack_keys(memoryview(data)[8 : 8 + size])
        at, beside = 8 + size, []
        for t in self.payload:
            beside.append(np.frombuffer(data, t, len(keys), at))
            at += len(keys) * np.dtype(t).itemsize
        return keys, beside


def ask(chunks: DataFrame, question: Question, total: int, name: str, few: int = FEW, bundle: int = BUNDLE) -> str:
    """Sends the keys of each chunk, about `total` of all, collects the answers, and returns the folder that has them."""
    spark = chunks.sparkSession
    counted = chunks.agg(F.count("*"), F.max(F.shiftright("chunk", 32))).first()
    parts, senders = parts_for(total, spark), counted[0]
    if total >= few * parts * senders:
        return _ask(chunks, question, parts, name)
    wide, turns, files = min(parts, max(1, math.isqrt(parts))), -(-senders // bundle), (counted[1] or 0) + 1
    # Neighbours are bound together, so that bundles are in the order of their chunks.
    turn = (F.shiftright("chunk", 32) * turns / files).cast("int")
    sent = chunks.mapInArrow(_send(question, wide), "part int, chunk long, blob binary").withColumn("turn", turn)

    def bind(table: pa.Table) -> pa.Table:
        order = np.argsort(table["chunk"].to_numpy(), kind="stable")
        own = [pa.array([x], t) for x, t in (((table["turn"][0].as_py() << 32) + table["part"][0].as_py(), pa.int64()), (table["part"][0].as_py(), pa.int32()))]
        return pa.table([*own, pa.array([table["chunk"].to_numpy()[order].tolist()], pa.list_(pa.int64())), pa.array([[table["blob"][i].as_py() for i in order.tolist()]], pa.list_(pa.binary()))], names=["chunk", "part", "chunks", "blobs"])

    bundles = shared.kept(sent.groupBy("part", "turn").applyInArrow(bind, "chunk long, part int, chunks array<long>, blobs array<binary>"), f"{name}-bundles")

    def members(row: dict) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        every = [question.unpack(b.as_py()) for b in row["blobs"].values]
        return [k for k, _ in every], [x for _, x in every]

    merged = replace(question, keys_of=lambda row: question.merge(*members(row)))
    told = _ask(bundles, merged, parts, f"{name}-told")
    out = shared.folder(spark, name)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            keys, beside = members(row)
            found = question.spread(answers(told, row["chunk"].as_py()), question.merge(keys, beside), keys, beside)
            numbers = row["chunks"].as_py()
            yield pa.record_batch({"chunk": pa.array(numbers, pa.int64()), "part": pa.array([row["part"].as_py()] * len(numbers), pa.int32()), "blob": pa.array([squeeze(np.asarray(f, np.uint8).tobytes()) for f in found], pa.binary())})

    gather(bundles.mapInArrow(back, "chunk long, part int, blob binary"), out, name)
    shared.drop(spark, told)
    return out


def _send(question: Question, parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            keys, beside = question.keys_of(row)
            used, begins, ends = shares(keys, parts, question.bits)
            blobs = [question.pack(keys[a:b], [x[a:b] for x in beside]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch({"part": pa.array(used, pa.int32()), "chunk": pa.array([row["chunk"].as_py()] * len(used), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return send


def _ask(chunks: DataFrame, question: Question, parts: int, name: str) -> str:
    out = shared.folder(chunks.sparkSession, name)

    def reply(table: pa.Table) -> pa.Table:
        order = np.argsort(table["chunk"].to_numpy(), kind="stable")
        numbers = table["chunk"].to_numpy()[order].tolist()
        every = [question.unpack(table["blob"][i].as_py()) for i in order.tolist()]
        found = question.answer([k for k, _ in every], [x for _, x in every])
        part = table["part"][0].as_py()
        return pa.table({"chunk": pa.array(numbers, pa.int64()), "part": pa.array([part] * len(numbers), pa.int32()), "blob": pa.array([squeeze(np.asarray(f, np.uint8).tobytes()) for f in found], pa.binary())})

    sent = chunks.mapInArrow(_send(question, parts), "part int, chunk long, blob binary")
    gather(sent.groupBy("part").applyInArrow(reply, "chunk long, part int, blob binary"), out, name)
    return out


def gather(replies: DataFrame, out: str, name: str) -> None:
    """Writes the answers (chunk, part, blob), those of PACK neighbouring chunks as one file: their number, the chunks, the
    ends of their answers, and these."""

    def file(table: pa.Table) -> pa.Table:
        chunk, part = table["chunk"].to_numpy(), table["part"].to_numpy()
        pieces: dict[int, list[bytes]] = {}
        for i in np.lexsort((part, chunk)).tolist():
            pieces.setdefault(int(chunk[i]), []).append(expand(table["blob"][i].as_py()))
        done = [squeeze(b"".join(p)) for p in pieces.values()]
        pack = table["pack"][0].as_py()
        head = np.array([len(done), *pieces, *np.cumsum([len(d) for d in done])], "<i8").tobytes()
        shared.put(f"{out}/{pack}.bin", head + b"".join(done))
        return pa.table({"pack": pa.array([pack], pa.int64())})

    packs = replies.withColumn("pack", F.shiftright("chunk", PACK.bit_length() - 1))
    done, path = shared.stored(packs.groupBy("pack").applyInArrow(file, "pack long"), f"{name}-done")
    shared.drop(replies.sparkSession, path)


def answers(folder: str, chunk: int) -> np.ndarray:
    """What the parts said of each key of a chunk; none where it sent none."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(posixpath.join(folder, f"{chunk >> (PACK.bit_length() - 1)}.bin"))
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return np.zeros(0, np.uint8)
    with system.open_input_file(at) as f:
        n = int.from_bytes(f.read(8), "little")
        head = np.frombuffer(f.read(16 * n), "<i8")
        own = np.flatnonzero(head[:n] == chunk)
        if not len(own):
            return np.zeros(0, np.uint8)
        ends = np.concatenate([[0], head[n:]])
        f.seek(8 + 16 * n + int(ends[own[0]]))
        return np.frombuffer(expand(f.read(int(ends[own[0] + 1] - ends[own[0]]))), np.uint8)


# Counts, the commonest question.


def merge_counts(most: int) -> Callable[[list[np.ndarray], list[list[np.ndarray]]], tuple[np.ndarray, list[np.ndarray]]]:
    """Sums of the counts of equal keys, up to the largest that their type holds."""

    def merge(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, [np.minimum(np.bincount(back, np.concatenate([b[0] for b in beside]), len(distinct)), most)]

    return merge


def spread_alike(answer: np.ndarray, merged: tuple[np.ndarray, list[np.ndarray]], keys: list[np.ndarray], _: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The same answer for a key wherever it comes from."""
    return [answer[np.searchsorted(merged[0], k)] for k in keys]


def sizes(keys: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(k) for k in keys])])


def totals(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each chunk and key, the sum of its counts over all chunks (1 each by default)."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order[1:]] != every[order[:-1]]
    group = np.cumsum(new) - 1
    weight = np.ones(len(every), np.int64) if counts is None else np.concatenate(counts).astype(np.int64)[order]
    total = np.zeros(len(every), np.int64)
    total[order] = np.bincount(group, weight).astype(np.int64)[group]
    at = sizes(keys)
    return [total[at[i] : at[i + 1]] for i in range(len(keys))]
