"""Substring deduplication by level-wise doubling.

A window of n words that occurs twice consists of windows of n/2 words that occur twice. So windows of `base` words
come first, over the whole corpus; where all windows within one of twice the length repeat, it is a candidate at the next
level, and only candidates are counted there, until the wanted length is reached or no candidate survives. At the last
level all but the first occurrence of each window (smaller doc_id, then earlier start) are covered, and covered words
go. Windows are judged on the input, not on what is left.

Levels go through `chunks.ask`: keys are hashes of windows, of `BITS` bits at the first levels, where a false match
only makes a candidate, and of 64 at the last, which has a second hash of 64 bits, by another factor, beside
each key: windows count as equal where all 128 bits are.

Edge cases: null and empty texts have no words; texts shorter than the window keep all; rows that repeat a doc_id are
separate documents, the one that lies first in the table of chunks being the earlier; null doc_ids come before all others; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .words import Words, second, windows, words

BITS = 48
BASE = 5


def levels(window: int, base: int = BASE) -> list[int]:
    """Lengths from about `base` on, each at most twice the one before, that end at `window`."""
    out = [window]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out


def _runs(w: Words, length: int, where: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a chunk that are candidates, and their first words."""
    keys, first = windows(w.hashes, w.bounds, length)
    if where is not None:
        keep = where[first]
        keys, first = keys[keep], first[keep]
    return keys, first


def _candidates(repeated: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Words at which a window of `longer` may start: the two windows of `length` that make it up both repeat."""
    gap = longer - length
    out = np.zeros(len(repeated), bool)
    n = max(0, len(repeated) - gap)  # a chunk may have fewer words than the gap
    out[:n] = repeated[:n] & repeated[gap : gap + n]
    return out


def _state(row: dict, steps: list[int], folders: list[str]) -> tuple[Words, np.ndarray | None]:
    """A chunk's words, and the candidates for the level after those that have been answered."""
    w = words([t.encode() for t in row["texts"].as_py()])
    where, chunk = None, row["chunk"].as_py()
    for level, folder in enumerate(folders):
        keys, first = _runs(w, steps[level], where)
        distinct, back = np.unique(keys >> np.uint64(64 - BITS), return_inverse=True)
        said = C.answers(folder, chunk)
        repeated = np.zeros(len(w.hashes), bool)
        if len(distinct):
            repeated[first] = said[back].astype(bool)
        where = _candidates(repeated, steps[level], steps[level + 1])
    return w, where


def _order(row: dict, w: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each window: its document's id (null: the least), and the document's number in the chunk and the word, as one."""
    ids = np.array([-(1 << 63) if i is None else i for i in row["ids"].as_py()], np.int64)
    doc = np.searchsorted(w.bounds, first, "right") - 1
    return ids[doc], (first - w.bounds[doc]).astype(np.int64)


def _ordered(keys: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by keys, and where keys are equal by the rest, which most are not asked for."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(keys) else np.zeros(0, np.int64)
    own = order[tied]
    order[tied] = own[np.lexsort([x[own] for x in (*reversed(then), keys)])] if len(own) else own
    return order


def _firsts(row: dict, w: Words, keys: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct windows of a chunk, ascending by hash; second hash, doc_id and start of the first occurrence of each; and
    that occurrence's number among the windows. Windows of one hash and different second hashes all stay: then a
    key comes more than once, which packs as a difference of 0."""
    ids, start = _order(row, w, first)
    other = second(w, window)[first]
    order = _ordered(keys, other, ids, start, np.arange(len(keys)))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    pick = order[new]
    return keys[pick], [other[pick], ids[pick], start[pick]], pick


def _least(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all occurrences the distinct windows, what lies beside the first of each, and which that is."""
    every, chunk = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    other, ids, start = (np.concatenate([b[i] for b in beside]) for i in range(3))
    order = _ordered(every, other, ids, start, chunk)
    new = np.ones(len(every), bool)
    new[1:] = (every[order[1:]] != every[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    pick = order[new]
    return every[pick], [other[pick], ids[pick], start[pick]], pick


def _split(flags: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    at = C.sizes(keys)
    return [flags[at[i] : at[i + 1]] for i in range(len(keys))]


def _first_of_all(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> list[np.ndarray]:
    flags = np.zeros(sum(map(len, keys)), np.uint8)
    flags[_least(keys, beside)[2]] = 1
    return _split(flags, keys)


def _merge_firsts(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    return _least(keys, beside)[:2]


def _spread_firsts(answer: np.ndarray, _: tuple, keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Of a bundle's window that is the first of all, the occurrence that is the bundle's first."""
    flags = np.zeros(sum(map(len, keys)), np.uint8)
    flags[_least(keys, beside)[2]] = answer
    return _split(flags, keys)


def _repeated(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [(t > 1).astype(np.uint8) for t in C.totals(keys, [b[0] for b in beside])]


def dedup(docs: DataFrame, window: int = 20, base: int = BASE, few: int = C.FEW, bundle: int = C.BUNDLE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of each row of docs (doc_id, text); kept is the text that is left."""
    chunked = C.cut(docs)
    total = chunked.agg(F.sum("n_words")).first()[0] or 0
    steps, folders = levels(window, base), []
    for level, length in enumerate(steps[:-1]):
        done = list(folders)

        def keys_of(row: dict, length: int = length, done: list[str] = done) -> tuple[np.ndarray, list[np.ndarray]]:
            w, where = _state(row, steps, done)
            keys, _ = _runs(w, length, where)
            distinct, counts = np.unique(keys >> np.uint64(64 - BITS), return_counts=True)
            return distinct, [np.minimum(counts, 2).astype(np.uint8)]

        question = C.Question(["<u1"], BITS, keys_of, _repeated, C.merge_counts(2), C.spread_alike)
        folders.append(C.ask(chunked, question, total, f"level-{length}", few, bundle))

    def last_keys(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        w, where = _state(row, steps, folders)
        return _firsts(row, w, *_runs(w, window, where), window)[:2]

    question = C.Question(["<u8", "<i8", "<i8"], 64, last_keys, _first_of_all, _merge_firsts, _spread_firsts)
    final = C.ask(chunked, question, total, f"level-{window}", few, bundle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.shared.pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            w, where = _state(row, steps, folders)
            keys, first = _runs(w, window, where)
            covered = np.zeros(len(w.hashes) + 1, np.int64)
            if len(keys):
                said = C.answers(final, row["chunk"].as_py())
                pick = _firsts(row, w, keys, first, window)[2]
                later = np.ones(len(keys), bool)
                later[pick[said.astype(bool)]] = False
                np.add.at(covered, first[later], 1)
                np.add.at(covered, first[later] + window, -1)
            gone = np.cumsum(covered[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            out = []
            for i, doc in enumerate(row["ids"].as_py()):
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                left = np.flatnonzero(~gone[a:b]) + a
                kept = b" ".join([w.data[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])
                out.append((doc, b - a, int(removed[b] - removed[a]), hashlib.sha256(kept).hexdigest(), kept.decode()))
            for at in range(0, len(out), 256):
                cols = list(zip(*out[at : at + 256], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return chunked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
