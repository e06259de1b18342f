"""Words of texts, and hashes of words and of runs of words, as arrays.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over its bytes modulo 2**64, mixed
together with its length; that of a run of words is a polynomial over the words' hashes, mixed. Prefix sums give those of
a block of bytes or words at once, so what a long text needs beside its words' places and hashes is one block's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers (any will do), and their inverses modulo 2**64.
_B, _C = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_B2, _C2 = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F
#: Bytes, or words, that are worked on at once.
BLOCK = 3 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several documents: hashes, bytes from `starts` to `ends` of `data`, and bounds of documents."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Mixed hashes of all runs of k words within a document, and the number of each run's first word."""
        return windows(self.hashes, self.bounds, k)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    if n < k or not counts.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = windows_at(hashes, k)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    first += np.arange(len(first))
    return mix(total[first]), first


def windows_at(hashes: np.ndarray, k: int, base: int = _C) -> np.ndarray:
    """Hashes of the k words from each on, whatever their documents, not mixed."""
    total = np.empty(len(hashes), np.uint64)
    for a in range(0, len(hashes), BLOCK):
        total[a : a + BLOCK] = _runs(hashes[a : a + BLOCK + k - 1], k, base)[:BLOCK]
    return total


def _runs(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomials over k hashes from each on, by doubling: binary digits of k. The last k - 1 mean nothing."""
    n = len(hashes)
    out, width = hashes.copy(), 1
    total, done, factor = np.zeros(n, np.uint64), 0, np.uint64(1)
    while True:
        if k >> (width.bit_length() - 1) & 1:
            total[: n - done] += factor * out[done:]
            done += width
            factor = np.uint64(pow(base, done, 1 << 64))
        if done >= k or width >= n or done >= n:
            return total
        out[: n - width] += np.uint64(pow(base, width, 1 << 64)) * out[width:]
        width *= 2


def words(texts: list[bytes], lower: bool = False) -> Words:
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    parts = []
    for a, b in _blocks(raw):
        starts, ends, hashes = _hashed(raw[a:b], lower)
        parts.append(((starts + a).astype(np.uint32), (ends + a).astype(np.uint32), hashes))
    starts, ends, hashes = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, begins.astype(np.uint32)))


def second(w: Words, k: int) -> np.ndarray:
    """Other hashes of the k words from each on, of the words' hashes mixed anew, by another factor."""
    return windows_at(mix(w.hashes ^ np.uint64(_C2)), k, _B2)


def _blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(raw):
        b = _cut(raw, a + BLOCK)
        yield a, b
        a = b


def _cut(raw: np.ndarray, at: int) -> int:
    """The end of the word that goes on at a place, or the end of all."""
    while at < len(raw):
        space = np.flatnonzero(_SPACE[raw[at - 1 : at + 4096]])
        if len(space):
            return at + int(space[0])
        at += 4097
    return len(raw)


def _hashed(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=sums[1:])
    back = _powers(pow(_B, -1, 1 << 64), n)
    plain = (sums[ends] - sums[starts]) * back[starts]
    return starts, ends, mix(plain + (ends - starts).astype(np.uint64) * np.uint64(_C))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of k words of each document, ascending, and bounds of documents; a document of
    fewer words is one run."""
    own, first = w.runs(k)
    docs = np.searchsorted(w.bounds, first, "right") - 1
    short = np.flatnonzero((np.diff(w.bounds) < k) & (np.diff(w.bounds) > 0))
    if len(short):
        extra = np.array([windows(w.hashes[a:b], np.array([0, b - a]), b - a)[0][0] for a, b in zip(w.bounds[short], w.bounds[short + 1], strict=True)], np.uint64)
        lengths = (w.bounds[short + 1] - w.bounds[short]).astype(np.uint64)
        own, docs = np.concatenate([own, mix(extra + lengths)]), np.concatenate([docs, short])
    order = np.lexsort((own, docs))
    own, docs = own[order], docs[order]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != own[:-1]) | (docs[1:] != docs[:-1])
    own, docs = own[keep], docs[keep]
    return own, np.searchsorted(docs, np.arange(len(w.bounds)))
