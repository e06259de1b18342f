"""Near duplicates by SimHash: fingerprints of 64 bits, linked where at most `radius` bits differ, found by BK-trees.

A bit of a fingerprint is set where it is set in over half of the XXH64 (seed 42) of a text's runs of `k` words, repeats included. Equal
fingerprints are one node from there on. The bits are cut into m blocks; two fingerprints that differ in at most `radius` bits agree
in m - radius of the blocks at least, so each fingerprint goes to one shard for each choice of so many blocks, and every link is met in one of
them. m grows with the number of fingerprints, so a shard has few of them at any size. A shard (a cell of it, `shards.cells`, where
it is large) is a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only the edges within the
radius. A shard's tree lies in the task that holds its rows and goes to every slice of rows that asks it; the trees do not pass the driver.

A cell keeps what it has linked as a forest, and gives a link only where it joins two of its trees, so links are fewer than rows
however many copies there are. Components then are sought over links.

Edge cases: null and empty texts, and texts without words, have the fingerprint zero, which is linked like any other; texts of
fewer words than k are one run; rows that repeat a doc_id are one document, linked with what any of them is linked with; null doc_ids
have a fingerprint, are linked with nothing and have a null component; an empty table gives an empty result. Long texts are read
in blocks of `BLOCK` bytes. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, shared
from .jaccard_join import components

#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
#: Fingerprints of a tree, and fingerprints for each value of a shard's bits from which on more blocks are taken.
LIMIT, DENSE = 8192, 256
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = (1 << 64) - 1


def _runs(text: str, k: int, block: int) -> Iterator[list[bytes]]:
    """Runs of k words, joined by spaces, of one block of the text after another."""
    raw, at, before, seen = text.encode(), 0, [], False
    while at < len(raw):
        end = _SPACE.search(raw, at + block)
        to = end.start() if end else len(raw)
        words = before + raw[at:to].lower().split()
        at = to
        if len(words) >= k:
            seen = True
            yield [b" ".join(run) for run in zip(*[words[i:] for i in range(k)])]  # noqa: B905
            words = words[len(words) - k + 1 :]
        before = words
    if before and not seen:
        yield [b" ".join(before)]


def fingerprint(text: str | None, k: int = 3, block: int = BLOCK) -> int:
    from xxhash import xxh64_intdigest

    ones, n = np.zeros(64, np.int64), 0
    for runs in _runs(text or "", k, block):
        hashes = np.array([xxh64_intdigest(run, 42) for run in runs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(runs)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, print) of each row of docs (doc_id, text); prints are signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.pieces(batches, 64):
            prints = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array(prints, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


class Tree:
    """A BK-tree of 64-bit numbers."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The place of a value; one that is there is not added again."""
        at = 0
        while self.values:
            apart = (self.values[at] ^ value).bit_count()
            if not apart:
                return at
            below = self.children[at].get(apart)
            if below is None:
                self.children[at][apart] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Places of the values within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            apart = (self.values[at] ^ value).bit_count()
            if apart <= radius:
                yield at
            low, high, children = apart - radius, apart + radius, self.children[at]
            if len(children) > 2 * radius + 1:
                stack += [children[d] for d in range(low, high + 1) if d in children]
            else:
                stack += [below for d, below in children.items() if low <= d <= high]


def shard_masks(blocks: int, radius: int) -> list[int]:
    """The bits that each kind of shard agrees in: all choices of blocks - radius blocks."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int, dense: int = DENSE) -> int:
    """The least number of blocks for which shards have at most about `dense` of n fingerprints each."""
    return next((m for m in range(radius + 1, 2 * radius + 3) if n <= dense << (64 * (m - radius) // m)), 2 * radius + 2)


def links(nodes: DataFrame, radius: int, blocks: int, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all `nodes` (print, node) of different prints that differ in at most `radius` bits, directly or through others."""
    masks = shard_masks(blocks, radius)
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col("print").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for i, m in enumerate(masks)]))
    rows = nodes.select("print", "node", kinds.alias("s")).select("s.kind", "s.value", "print", "node")
    keys = ["kind", "value"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            tree, alone, owner, parent = Tree(), False, [], {}

            def top(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for cell, (value, node, asks) in shards.groups(batches, keys, ["print", "node"]):
                if cell:
                    tree, alone, owner, parent = Tree(), cell[-2] == cell[-1], [], {}
                value &= _ALL
                if asks or alone:
                    for at in tree.near(value, radius):
                        a, b = top(node), top(owner[at])
                        if a != b:
                            parent[a] = b
                            yield owner[at], node
                if not asks and tree.add(value) == len(owner):
                    owner.append(node)

        pairs = found()
        while some := list(itertools.islice(pairs, 10_000)):
            yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip("ab", zip(*some, strict=True), strict=True)})

    return shards.cells(rows, keys, "print", limit).mapInArrow(search, "a long, b long")


def dedup(docs: DataFrame, k: int = 3, radius: int = 3, blocks: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text)."""
    prints = shared.kept(fingerprints(docs, k), "prints")
    with shared.scratch(docs.sparkSession, "owners"):
        known = prints.where("doc_id IS NOT NULL")
        nodes = shared.kept(known.groupBy("print").agg(F.min("doc_id").alias("node")), "nodes")
        found = links(nodes, radius, blocks or blocks_for(nodes.count(), radius), limit)
        # A document that rows with several fingerprints have is a node, too, and holds theirs together.
        several = known.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("doc_id")
        held = known.join(shared.kept(several, "several"), "doc_id").join(nodes, "print").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        edges = shared.kept(found.union(held), "links")
        labels = components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges, "components")
        owners = shared.kept(nodes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component_id")), "owners")
    return prints.join(owners, "print", "left").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
