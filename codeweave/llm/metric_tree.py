"""Exact top-k by inner product: M-trees searched best first.

Inner product becomes distance by one more component: with R the largest norm, x' = (x, sqrt(R^2 - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, so the largest products are the nearest points of a metric space.

Rows are dealt to blocks; each block becomes a tree of pages, a file in the shared folder. A page holds entries: routing
objects with a covering radius, or vectors; each with its stored distance to the page's own routing object. A search
takes the page with the least possible distance first. Before any distance to an entry is computed, the stored one
gives the bound |d(q, parent) - d(parent, entry)| - radius <= d(q, entry); an entry whose bound is beyond the k-th
nearest so far is skipped. A task has one part of the queries and goes through a group of trees one after another; what a
query has found in one tree bounds its search in the next. The k best of each group meet by query. Scores are
exact integers; the float distances only prune, with a margin for rounding.

Vectors with a component of 2**26 or more after scaling leave the range in which floats are exact. They lie in blocks
of their own, and pairs with them are scanned: floats choose what may be among the k best, integers of any size decide. A score
beyond the range of 64 bits counts, and is returned, as that range's end.

Edge cases: vectors that are null or hold null or non-finite components, and null ids, take no part; empty vectors have
products of 0 with each other; vectors of another length than the query's are no candidates; rows that repeat an id are
candidates each, but not of that id's query, which is asked once for each length, with its least vector. Ties go to the smaller
id. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import BLOCK_ROWS, GROUP, QUERY_ROWS, apart, groups, salted, stack, usable

PAGE = 192
#: Scaled components from which on a vector is scanned for, not searched.
WIDE = 1 << 26
#: Ends of the range of scores.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Share of a distance that float rounding may take.
MARGIN = 1e-9


@dataclass
class Page:
    """Entries of one page; those of a leaf are the rows from `first` on of the tree, others are pages."""

    leaf: bool
    first: int
    children: np.ndarray
    parent_distance: np.ndarray
    radius: np.ndarray
    points: np.ndarray = field(repr=False)


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Of vectors of whole numbers below WIDE."""
        vectors = vectors.astype(float)
        squares = (vectors**2).sum(1)
        self.square = float(squares.max())
        points = np.column_stack([vectors, np.sqrt(np.maximum(0, self.square - squares))])
        self.pages: list[Page] = []
        rng = np.random.default_rng(len(ids))
        level, pivots, radii, rows, none = [], [], [], [], np.zeros(0)
        at = 0
        for own, pivot in self._split(np.arange(len(ids)), points, rng):
            d = np.linalg.norm(points[own] - pivot, axis=1)
            level.append(len(self.pages))
            pivots.append(pivot)
            radii.append(float(d.max()))
            self.pages.append(Page(True, at, none, d, np.zeros(len(own)), none))
            rows.append(own)
            at += len(own)
        order = np.concatenate(rows)
        self.vectors, self.ids = vectors[order], ids[order]
        while len(level) > 1:
            numbers, objects, covers = np.array(level), np.array(pivots), np.array(radii)
            level, pivots, radii = [], [], []
            for own, pivot in self._split(np.arange(len(numbers)), objects, rng):
                d = np.linalg.norm(objects[own] - pivot, axis=1)
                level.append(len(self.pages))
                pivots.append(pivot)
                radii.append(float((d + covers[own]).max()))
                self.pages.append(Page(False, 0, numbers[own], d, covers[own], objects[own]))
        self.root, self.root_pivot, self.root_radius = level[0], pivots[0], radii[0]

    @staticmethod
    def _split(rows: np.ndarray, points: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of at most PAGE near points, each with one of them as its routing object."""
        todo = [rows]
        while todo:
            own = todo.pop()
            if len(own) <= PAGE:
                centre = points[own].mean(0)
                yield own, points[own[np.argmin(((points[own] - centre) ** 2).sum(1))]]
                continue
            k = min(PAGE, -(-2 * len(own) // PAGE))
            seeds = points[rng.choice(own, k, replace=False)]
            near = np.argmin((seeds**2).sum(1) - 2 * points[own] @ seeds.T, axis=1)
            parts = [own[near == j] for j in range(k)]
            parts = [p for p in parts if len(p)]
            if len(parts) == 1:  # equal points: cut anywhere
                parts = [own[i : i + PAGE] for i in range(0, len(own), PAGE)]
            small: list[np.ndarray] = []
            for p in parts:  # groups far below a page share one
                if len(p) > PAGE:
                    todo.append(p)
                elif small and len(small[-1]) + len(p) <= PAGE and len(p) < PAGE // 4:
                    small[-1] = np.concatenate([small[-1], p])
                else:
                    small.append(p)
            todo.extend(small)

    def search(self, query: np.ndarray, k: int, skip: int | None = None, best: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), best first, and how many distances were computed. `best`, a heap of (score, -id),
        holds what other trees gave and is added to."""
        q = np.append(query.astype(float), 0.0)
        base = float(q @ q) + self.square
        slack = MARGIN * (1 + base)
        # Sums of products of whole numbers are exact in floats while they stay below 2**53.
        most = np.sqrt(self.square * float(q @ q))
        kind = float if most < 1 << 52 else np.int64 if most < 1 << 61 else object
        exact = q[:-1].astype(np.int64).astype(kind)
        best = [] if best is None else best  # a heap whose least is (k-th score, -id)
        reach = self._reach(best, k, base, slack)
        computed = 1
        d_root = float(np.linalg.norm(q - self.root_pivot))
        heap = [(max(0.0, d_root - self.root_radius), self.root, d_root)]
        while heap:
            bound, at, d_page = heapq.heappop(heap)
            if bound > reach:
                break
            page = self.pages[at]
            open_ = np.abs(d_page - page.parent_distance) - page.radius <= reach
            n = int(np.count_nonzero(open_))
            computed += n
            if not n:
                continue
            if page.leaf:
                rows = slice(page.first, page.first + len(open_))
                vectors, ids = self.vectors[rows], self.ids[rows]
                if n < len(open_):
                    vectors, ids = vectors[open_], ids[open_]
                scores = (vectors if kind is float else vectors.astype(np.int64).astype(kind)) @ exact
                if kind is object:
                    scores = np.clip(scores, LEAST, MOST)
                if len(best) == k:
                    fit = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[fit], ids[fit]
                found = False
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i != skip and (len(best) < k or (s, -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (int(s), -i))
                        found = True
                if found:
                    reach = self._reach(best, k, base, slack)
            else:
                points, children, radius = (x if n == len(open_) else x[open_] for x in (page.points, page.children, page.radius))
                d = np.sqrt(((points - q) ** 2).sum(1))
                bounds = np.maximum(0, d - radius)
                for j in np.flatnonzero(bounds <= reach).tolist():
                    heapq.heappush(heap, (float(bounds[j]), int(children[j]), float(d[j])))
        return [(s, -i) for s, i in sorted(best, reverse=True)], computed

    @staticmethod
    def _reach(best: list[tuple[int, int]], k: int, base: float, slack: float) -> float:
        """The distance beyond which nothing is among the k best."""
        return np.inf if len(best) < k or best[0][0] <= LEAST else float(np.sqrt(max(0.0, base - 2 * best[0][0]) + slack))

    def pack(self) -> bytes:
        """The tree as Arrow: vectors and ids once, pages as slices of entries."""
        pages = pa.record_batch({"leaf": pa.array([p.leaf for p in self.pages]), "entries": pa.array([len(p.radius) for p in self.pages], pa.int32())})
        child = [np.zeros(len(p.radius)) if p.leaf else p.children for p in self.pages]
        flat = pa.record_batch({"child": np.concatenate(child).astype(np.int32), "parent_distance": np.concatenate([p.parent_distance for p in self.pages]), "radius": np.concatenate([p.radius for p in self.pages])})
        inner = [p.points.ravel() for p in self.pages if not p.leaf]
        head = pa.record_batch({"dim": [self.vectors.shape[1]], "square": [self.square], "root": [self.root], "root_radius": [self.root_radius], "root_pivot": [self.root_pivot], "inner": [np.concatenate(inner) if inner else np.zeros(0)]})
        ids, values = pa.record_batch({"id": self.ids}), pa.record_batch({"v": self.vectors.ravel().astype(np.int32)})
        sink = pa.BufferOutputStream()
        for batch in (head, pages, flat, ids, values):
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, data: bytes) -> MTree:
        source = pa.BufferReader(data)
        head, pages, flat, ids, values = (pa.ipc.open_stream(source).read_all() for _ in range(5))
        tree = cls.__new__(cls)
        h, none = head.to_pylist()[0], np.zeros(0)
        tree.ids, tree.vectors = ids["id"].to_numpy(), values["v"].to_numpy().astype(float).reshape(len(ids), h["dim"])
        tree.square, tree.root, tree.root_radius, tree.root_pivot = h["square"], h["root"], h["root_radius"], np.array(h["root_pivot"])
        inner, at, used, rows, d = np.array(h["inner"]), 0, 0, 0, h["dim"] + 1
        tree.pages = []
        child, far, cover = (flat[c].to_numpy() for c in ("child", "parent_distance", "radius"))
        for leaf, n in zip(pages["leaf"].to_pylist(), pages["entries"].to_pylist(), strict=True):
            points = none if leaf else inner[used : used + n * d].reshape(n, d)
            tree.pages.append(Page(leaf, rows, none if leaf else child[at : at + n], far[at : at + n], cover[at : at + n], points))
            used += 0 if leaf else n * d
            rows += n if leaf else 0
            at += n
        return tree


def whole(v: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, as integers of any size."""
    return [int(np.floor(x * scale)) if abs(x) < 1e300 else int(x) * scale for x in v.tolist()]


def scan(vectors: np.ndarray, ids: np.ndarray, scale: int, query: np.ndarray, query_scale: int, k: int, skip: int, best: list[tuple[int, int]]) -> None:
    """Adds the best of a block, of any components, to the heap `best`."""
    ids, vectors = ids[ids != skip], vectors[ids != skip]
    if not len(ids):
        return
    shifts = [int(np.frexp(np.abs(v).max(initial=1.0))[1]) for v in (vectors, query)]
    x, q = (np.ldexp(v, -e) for v, e in zip((vectors, query), shifts, strict=True))
    # Rounding down takes less than 1 from each scaled component, floats a share of each product.
    steps = [np.ldexp(1.0 / n, -e) for n, e in zip((scale, query_scale), shifts, strict=True)]
    slack = np.abs(x).sum(1) * steps[1] + np.abs(q).sum() * steps[0] + len(q) * steps[0] * steps[1] + MARGIN * (np.abs(x) @ np.abs(q)) + 1e-300
    rough = x @ q
    low, high = rough - slack, rough + slack
    floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    end = float(MOST) * (1 - MARGIN) * steps[0] * steps[1]  # from here on scores count alike
    floor = -np.inf if floor <= -end else min(floor, end)
    own = whole(query, query_scale)
    for j in np.flatnonzero(high >= floor).tolist():
        s = min(MOST, max(LEAST, sum(a * b for a, b in zip(whole(vectors[j], scale), own, strict=True))))
        item = (s, -int(ids[j]))
        if len(best) < k:
            heapq.heappush(best, item)
        elif item > best[0]:
            heapq.heapreplace(best, item)


def build(rows: DataFrame, out: str, scale: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Writes a file below `out` for each block of rows (vec_id, v, dim, wide); (dim, wide, last), the last block of each."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        dim, wide, block = (int(own[c].iloc[0]) for c in ("dim", "wide", "block"))
        v, ids = stack(own["v"], dim), own["vec_id"].to_numpy(np.int64)
        if wide:
            sink = pa.BufferOutputStream()
            for batch in (pa.record_batch({"id": ids}), pa.record_batch({"v": v.ravel()})):
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch)
            data = sink.getvalue().to_pybytes()
        else:
            data = MTree(np.floor(v * scale), ids).pack()
        shared.put(f"{out}/{dim}-{wide}-{block}.tree", data)
        return pd.DataFrame({"dim": [dim], "wide": [wide], "block": [block]})

    blocks, last = salted(rows, ["dim", "wide"], block_rows, "block")
    done = apart(blocks, "dim", "wide", "block").groupBy("dim", "wide", "block").applyInPandas(one, "dim int, wide int, block int")
    shared.kept(done, "trees-done")
    return shared.kept(last, "trees-last")


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k largest products."""
    spark = embeddings.sparkSession
    found = usable(embeddings, empty=True)
    rows = shared.kept(found.withColumn("wide", F.exists("v", lambda x: F.abs(x) * float(scale) >= WIDE - 1).cast("int")), "vectors")
    out = shared.folder(spark, "trees")
    last = build(rows, out, scale, block_rows)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "wide")).alias("q"))
    asked = shared.kept(asked.select("vec_id", "dim", "q.v", F.col("q.wide").alias("asks_wide")), "queries")
    parts, _ = salted(asked, ["dim"], query_rows, "part")
    keys = ["dim", "wide", "part", "first", "final"]
    spread = apart(groups(parts, ["dim"], last, group), *keys)

    def visit(queries: pd.DataFrame) -> pd.DataFrame:
        dim, wide, first, final = (int(queries[c].iloc[0]) for c in ("dim", "wide", "first", "final"))
        asked = [(int(i), v, int(w), []) for i, v, w in zip(queries["vec_id"], stack(queries["v"], dim), queries["asks_wide"], strict=True)]
        for block in range(first, final + 1):
            data = shared.get(f"{out}/{dim}-{wide}-{block}.tree")
            if wide:
                source = pa.BufferReader(data)
                ids, flat = (pa.ipc.open_stream(source).read_all() for _ in range(2))
                ids, vectors, tree, own = ids["id"].to_numpy(), flat["v"].to_numpy().reshape(len(ids), dim), None, scale
            else:
                tree = MTree.unpack(data)
                ids, vectors, own = tree.ids, tree.vectors, 1
            for qid, v, asks_wide, best in asked:
                if tree is not None and not asks_wide:
                    tree.search(np.floor(v * scale), k, qid, best)
                else:
                    scan(vectors, ids, own, v, scale, k, qid, best)
        rows = [(qid, -i, s) for qid, _, _, best in asked for s, i in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    done = spread.groupBy(*keys).applyInPandas(visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
