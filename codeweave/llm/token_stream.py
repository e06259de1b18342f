"""Token ids as a binary stream: static range asymmetric numeral system (rANS).

A corpus is one long run of ids in ascending order of document ids. One table of frequencies, counted over the whole
corpus, serves all blocks. The ids of a file are cut into blocks of `BLOCK` ids; a block is coded by `LANES` states at
once (id k belongs to lane k mod LANES), all words in one list. Every `SPAN` steps a checkpoint keeps the lanes' states,
the place in the list and the CRC-32 of the span's ids: a reader may begin at any of them and check what it has read
without the rest of the block. Blocks are coded, and spans decoded, `ABREAST` at a time, as rows of one array.

File (`.rans`, little-endian):

    header   "RTS2", u32 crc of the table, u32 blocks, u32 documents, u64 ids
    docs     u32 length, zlib of: i64 doc_id[n] (deltas), u32 n_tokens[n], u32 crc32 of each document's ids
    block    u32 ids, u32 words, u32 checkpoints;
             per checkpoint u32 step, u32 word, u32 crc32 of the span's ids, u32 0, u64 state[LANES]; u32 word[words]

The table itself is `table.bin`: "RTT1", u32 symbols, u32 freq[symbols], frequencies adding up to 2**BITS.

Edge cases: null text counts as empty; an empty text is the end id alone; rows with the same doc_id stay separate, in
the order of a hash of their ids and then of the ids (only rows that are alike in both may change places, which shows
nowhere); null doc_ids come first; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, gathered

#: Frequencies add up to 2**BITS; states stay in [2**31, 2**63).
BITS = 20
LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK = 1 << 18
#: Steps of all lanes from one checkpoint to the next.
SPAN = 128
#: Blocks, or spans of blocks, that one run of array operations works on.
ABREAST = 8
#: Ids of a file, about; whole documents only.
FILE_IDS = 1 << 23


# --- frequency table ------------------------------------------------------------------------------------------------


def scale(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """uint32 frequencies that add up to 2**bits; at least 1 for what occurs, 0 for the rest."""
    total, room = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > room:
        raise ValueError("more symbols than the table has room for")
    freq = np.where(counts > 0, np.maximum(1, counts * (room / total)), 0).astype(np.int64)
    off = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    for k in order:
        if off == 0:
            break
        step = off if off > 0 else -min(-off, int(freq[k]) - 1)
        freq[k] += step
        off -= step
    return freq.astype(np.uint32)


def pack_table(freq: np.ndarray) -> bytes:
    return b"RTT1" + struct.pack("<I", len(freq)) + freq.astype("<u4").tobytes()


def unpack_table(data: bytes) -> np.ndarray:
    if data[:4] != b"RTT1":
        raise ValueError("not a frequency table")
    return np.frombuffer(data, "<u4", struct.unpack_from("<I", data, 4)[0], 8)


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.freq = freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.limit = self.freq << np.uint64(63 - BITS)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray) -> bytes:
        """The blocks of a run of ids; for no ids an empty block."""
        whole = len(ids) // BLOCK * BLOCK
        out = [] if len(ids) else [struct.pack("<3I", 0, 0, 0)]
        for a in range(0, whole, ABREAST * BLOCK):
            out += self._encode(ids[a : min(whole, a + ABREAST * BLOCK)].reshape(-1, BLOCK))
        if whole < len(ids):
            out += self._encode(ids[None, whole:])
        return b"".join(out)

    def _encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of equal length, a row each. The last ids are coded first, so that decoding runs forwards."""
        rows, n = ids.shape
        bits, steps = np.uint64(BITS), -(-n // LANES)
        if not self.freq[ids].all():
            raise ValueError("an id that the table does not have")
        x = np.full((rows, LANES), LOW, np.uint64)
        words: list[np.ndarray] = []
        counts = np.zeros((steps, rows), np.int64)
        states: list[tuple[int, np.ndarray]] = []
        for s in range(steps - 1, -1, -1):
            a, b = s * LANES, min(n, (s + 1) * LANES)
            own = ids[:, a:b]
            y, f = x[:, : b - a], self.freq[own]
            big = y >= self.limit[own]
            words.append(y[big].astype(np.uint32))
            counts[s] = np.count_nonzero(big, axis=1)
            y = np.where(big, y >> np.uint64(32), y)
            q = y // f
            x[:, : b - a] = (q << bits) + (y - q * f) + self.first[own]
            if s % SPAN == 0:
                states.append((s, x.copy()))
        flat = np.concatenate(words[::-1])
        order = np.argsort(np.repeat(np.tile(np.arange(rows, dtype=np.uint8), steps), counts.ravel()), kind="stable")
        flat, held = flat[order].astype("<u4"), counts.sum(0)
        ends, before = np.cumsum(held), np.cumsum(counts, axis=0) - counts
        out = []
        for r in range(rows):
            marks = b"".join(struct.pack("<4I", s, int(before[s, r]), zlib.crc32(ids[r, s * LANES : (s + SPAN) * LANES].astype("<u4").tobytes()), 0) + state[r].astype("<u8").tobytes() for s, state in reversed(states))
            out.append(struct.pack("<3I", n, int(held[r]), len(states)) + marks + flat[ends[r] - held[r] : ends[r]].tobytes())
        return out

    def decode(self, data: memoryview, at: int, mark: int = 0, marks: int | None = None) -> tuple[np.ndarray, int]:
        """Ids of the block at `at` from checkpoint `mark` on, for `marks` checkpoints or to its end; where it ends."""
        spans, end = self.spans(data, at)
        own = spans[mark : None if marks is None else mark + marks]
        return (np.concatenate(self.read(own)) if own else np.zeros(0, np.uint32)), end

    def spans(self, data: memoryview, at: int) -> tuple[list[tuple], int]:
        """What decoding each span of the block at `at` needs (ids, crc, states, words), and where the block ends."""
        n, held, marks = struct.unpack_from("<3I", data, at)
        at += 12
        size = 16 + 8 * LANES
        end = at + marks * size + 4 * held
        if end > len(data):
            raise ValueError("a stream that lacks ids")
        words, out = np.frombuffer(data, "<u4", held, at + marks * size), []
        for m in range(marks):
            step, word, crc, _ = struct.unpack_from("<4I", data, at + m * size)
            out.append((min(n - step * LANES, SPAN * LANES), crc, np.frombuffer(data, "<u8", LANES, at + m * size + 16), words[word:]))
        return out, end

    def read(self, spans: list[tuple]) -> list[np.ndarray]:
        """The ids of each span; spans of equal length are decoded side by side."""
        out: list[np.ndarray | None] = [None] * len(spans)
        by: dict[int, list[int]] = {}
        for i, span in enumerate(spans):
            by.setdefault(span[0], []).append(i)
        for n, places in by.items():
            for a in range(0, len(places), ABREAST):
                own = places[a : a + ABREAST]
                ids = self._read(n, [spans[i][2] for i in own], [spans[i][3] for i in own])
                for i, row in zip(own, ids, strict=True):
                    if zlib.crc32(row.astype("<u4").tobytes()) != spans[i][1]:
                        raise ValueError("a damaged block: ids differ from those written")
                    out[i] = row
        return out  # type: ignore[return-value]

    def _read(self, n: int, states: list[np.ndarray], lists: list[np.ndarray]) -> np.ndarray:
        # A span has at most a word for each id; a list that ends early gets words that the CRC then finds.
        words = np.concatenate([*[w[:n] for w in lists], np.zeros(LANES * len(lists), np.uint32)])
        at = np.cumsum([0] + [min(len(w), n) for w in lists[:-1]])
        x = np.stack(states).astype(np.uint64)
        out = np.empty((len(states), n), np.uint32)
        mask, bits, symbol, last = np.uint64((1 << BITS) - 1), np.uint64(BITS), self.symbol, len(words) - 1
        for a in range(0, n, LANES):
            b = min(n, a + LANES)
            y = x[:, : b - a]
            slot = y & mask
            s = symbol[slot]
            out[:, a:b] = s
            y = self.freq[s] * (y >> bits) + slot - self.first[s]
            low = y < LOW
            counts = np.count_nonzero(low, axis=1)
            places = np.flatnonzero(low)
            word = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(places))
            flat = y.ravel()
            flat[places] = (flat[places] << np.uint64(32)) | words[np.minimum(word, last)]
            at = at + counts
            x[:, : b - a] = flat.reshape(y.shape)
        return out


def pack_file(coder: Coder, doc_ids: np.ndarray, counts: np.ndarray, crcs: np.ndarray, ids: np.ndarray) -> bytes:
    docs = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + counts.astype("<u4").tobytes() + crcs.astype("<u4").tobytes(), 1)
    blocks = -(-len(ids) // BLOCK)
    return b"RTS2" + struct.pack("<IIIQ", coder.crc, blocks, len(doc_ids), len(ids)) + struct.pack("<I", len(docs)) + docs + (coder.encode(ids) if blocks else b"")


def unpack_file(coder: Coder, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, n_tokens, CRC-32 sums and all ids; raises where a sum differs."""
    view = memoryview(data)
    if view[:4] != b"RTS2":
        raise ValueError("not a token stream")
    crc, blocks, n, total = struct.unpack_from("<IIIQ", view, 4)
    if crc != coder.crc:
        raise ValueError("the stream was written with another table")
    size = struct.unpack_from("<I", view, 24)[0]
    docs = zlib.decompress(view[28 : 28 + size])
    doc_ids = np.cumsum(np.frombuffer(docs, "<i8", n))
    counts, crcs = np.frombuffer(docs, "<u4", n, 8 * n), np.frombuffer(docs, "<u4", n, 12 * n)
    at, spans = 28 + size, []
    for _ in range(blocks):
        part, at = coder.spans(view, at)
        spans += part
    ids = np.concatenate(coder.read(spans)) if spans else np.zeros(0, np.uint32)
    if len(ids) != total or int(counts.sum(dtype=np.int64)) != total:
        raise ValueError("a stream that lacks ids")
    return doc_ids, counts, crcs, ids


# --- Spark ----------------------------------------------------------------------------------------------------------

_STAGED = "doc_id long, n_tokens int, ids binary, sym array<int>, cnt array<long>"


def _tokenize(path: str, end_id: int):
    """Ids of each document, 2 or 4 bytes each; after a task's last document a row with its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        top = max(enc.vocabulary, end_id + 1)
        kind = np.dtype("<u2") if top <= 1 << 16 else np.dtype("<u4")
        counts = np.zeros(top, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("sym", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int64()))])
        for batch in shared.pieces(gathered(batches), 1 << 16):
            got = [np.append(ids, np.uint32(end_id)) for ids in enc.encode(batch.column(1))]
            counts += np.bincount(np.concatenate(got), minlength=top)
            yield pa.record_batch([batch.column(0), pa.array(map(len, got), pa.int32()), pa.array([g.astype(kind).tobytes() for g in got], pa.binary()), pa.nulls(len(got), schema[3].type), pa.nulls(len(got), schema[4].type)], schema=schema)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([used], schema[3].type), pa.array([counts[used]], schema[4].type)], schema=schema)

    return run


def _write(out: str, freq: bytes, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(unpack_table(freq))
        shard, part, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal part, held, rows
            ids = np.concatenate([r[1] for r in rows])
            name = f"{out}/{shard:07d}-{part:05d}.rans"
            docs = np.array([r[0] for r in rows], np.int64)
            lens = np.array([len(r[1]) for r in rows])
            crcs = np.array([zlib.crc32(r[1].astype("<u4").tobytes()) for r in rows])
            shared.put(name, pack_file(coder, docs, lens, crcs, ids))
            part, held, rows = part + 1, 0, []
            return pa.record_batch({"file": [name.rpartition("/")[2]], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

        kind = np.dtype("<u2") if len(coder.freq) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(ids.as_buffer(), kind)
                rows.append((NULL_ID if doc is None else doc, ids))
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if rows:
            yield flush()

    return run


#: Stands for a null doc_id in a file.
NULL_ID = -(1 << 63)


def _read(freq: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(unpack_table(freq))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, crcs, ids = unpack_file(coder, content.as_buffer())
                ends = np.cumsum(counts.astype(np.int64))
                starts, raw = ends - counts, memoryview(ids.astype("<u4").tobytes())
                real = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                if real != crcs.tolist():
                    raise ValueError("a document whose ids differ from those written")
                n = len(docs)
                yield pa.record_batch({"file": [path.rpartition("/")[2]] * n, "doc_id": pa.array(docs, mask=docs == NULL_ID), "local": pa.array(starts.astype(np.int64)), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(real, pa.int64())})

    return run


def write_stream(docs: DataFrame, tokenizer: str, out: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the documents (doc_id, text) below `out`; returns the manifest (file, n_docs, n_ids, start).

    Texts are encoded once, to a table in the shared folder; the counts of ids (a row for each id and task at most) meet in a
    sum, of which the driver gets one row for each id of the vocabulary. The table is dealt by ranges of doc_id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged, at = shared.stored(rows.mapInArrow(_tokenize(tokenizer, end_id), _STAGED), "ids")
    counted = staged.where("n_tokens < 0").select(F.explode(F.arrays_zip("sym", "cnt")).alias("x")).groupBy("x.sym").agg(F.sum("x.cnt").alias("n")).collect()
    counts = np.zeros(max((r["sym"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["sym"]] = r["n"]
    top = max(len(counts), encoder(tokenizer).vocabulary, end_id + 1)
    freq = scale(np.append(counts, np.zeros(top - len(counts), np.int64)))
    table = pack_table(freq)
    shared.put(f"{out}/table.bin", table)
    # Rows of one id, null ids among them, are dealt by a hash of their ids, and rows alike in that by their place.
    rows = staged.where("n_tokens >= 0").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("m"))
    first = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(first, F.asc("h"), F.asc("m")).sortWithinPartitions(first, "h", "ids").select("doc_id", "ids")
    manifest = shared.kept(dealt.mapInArrow(_write(out, table, file_ids), "file string, n_docs long, n_ids long"), "manifest")
    shared.drop(spark, at)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_stream(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; every sum is checked."""
    table = spark.read.format("binaryFile").load(f"{out}/table.bin").select("content").first()[0]
    found = shared.files(spark, out, ".rans").mapInArrow(_read(bytes(table)), "file string, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(manifest.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def stream(docs: DataFrame, tokenizer: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the corpus as a token stream in the shared folder and reads it back."""
    out = shared.folder(docs.sparkSession, "stream")
    return read_stream(docs.sparkSession, out, write_stream(docs, tokenizer, out, end_id, file_ids))
