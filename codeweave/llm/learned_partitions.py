"""Approximate nearest neighbours by learned partitions.

On a bounded sample of rows the driver builds the graph of nearest neighbours and cuts it into partitions of equal
size that keep neighbours together; a small neural classifier then learns, from a vector, in which partitions its
neighbours lie. Every row of the table is indexed in the partition that the classifier gives it, rows of the sample among
them; a query goes to its most probable partitions, where exact cosines rank the rows. How many partitions a query
probes is its own: the most probable ones until their probabilities add up to a mass, the least by which the sample's held-out rows reach
the recall. Queries within a cluster are sure of a few partitions, those between clusters of none. There are more partitions for larger
tables, as many as the sample can teach.

Only the fit sees a sample (`sample` rows, those with the least hashed ids); all rows are indexed. Rows of a partition are
dealt to blocks, files in the shared folder, so a partition that many equal vectors fill does not meet in one task; a
partition's queries are dealt to parts, and a task has one part and goes through a group of blocks one after another.

Edge cases: see `vectors.usable`; zero vectors take no part either; vectors of another length than most in the sample
are a partition of their own for each length; ties go to the smaller id; fewer than k candidates: all of them; rows
that repeat an id are candidates each, such a query is asked once, with its least vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import shared
from .vectors import BLOCK_ROWS, GROUP, QUERY_ROWS, apart, groups, matrix, salted, stack, usable

#: Rows that the fit may see.
SAMPLE = 8_000
#: Partitions at least, rows of the sample that teach each of them at least, and rows of a partition that are aimed at.
PARTITIONS, TEACHERS = 16, 60
PARTITION_ROWS = 1 << 15
NEIGHBOURS = 10
HIDDEN = 128
RECALL = 0.96


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbours(x: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The k nearest other rows of each of `rows` (all rows by default) by cosine, in blocks."""
    rows = np.arange(len(x)) if rows is None else rows
    k, out = min(k, len(x) - 1), []
    for at in range(0, len(rows), 128):
        own = rows[at : at + 128]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(own), 0), int))
    return np.concatenate(out)


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8) -> np.ndarray:
    """A partition of each row: equal halves along principal directions, then moves towards the neighbours' partitions
    for as long as sizes stay within a tenth of the mean."""
    part = np.zeros(len(x), np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                c = x[own] - x[own].mean(0)
                direction = rng.normal(size=x.shape[1])
                for _ in range(12):
                    direction = c.T @ (c @ direction)
                    direction /= np.linalg.norm(direction) + 1e-30
                part[own[np.argsort(c @ direction, kind="stable")[len(own) // 2 :]]] = p + done
        done *= 2
    room = int(1.1 * len(x) / done) + 1
    both = [set(r) for r in near.tolist()]
    for i, r in enumerate(near.tolist()):
        for j in r:
            both[j].add(i)
    links = [np.fromiter(s, np.int64, len(s)) for s in both]
    sizes = np.bincount(part, minlength=done)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[links[i]], minlength=done)
            votes[(sizes >= room) & (np.arange(done) != part[i])] = 0
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass
class Router:
    """Softmax over partitions from one hidden layer; bounded by HIDDEN and the sample's size, so it may be broadcast."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def partition(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All partitions, most probable first, and what the probabilities of those before each add up to."""
        z = self.logits(x)
        e = np.exp(z - z.max(1, keepdims=True))
        order = np.argsort(-z, axis=1, kind="stable")
        own = np.take_along_axis(e / e.sum(1, keepdims=True), order, axis=1)
        return order, np.cumsum(own, axis=1) - own

    def routes(self, x: np.ndarray) -> list[list[int]]:
        """The partitions to probe for each row, most probable first: one at least."""
        order, before = self.ranked(x)
        return [row[: max(1, int(n))].tolist() for row, n in zip(order, (before < self.mass).sum(1), strict=True)]


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, rate: float = 0.01) -> Router:
    """Adam on the cross entropy between the softmax and `target`, a distribution over partitions for each row."""
    d, p = x.shape[1], target.shape[1]
    weights = [rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, p)) * np.sqrt(1 / HIDDEN), np.zeros(p)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            a = x[own] @ weights[0] + weights[1]
            h = np.maximum(0, a)
            z = h @ weights[2] + weights[3]
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            g = (e / e.sum(1, keepdims=True) - target[own]) / len(own)
            back = (g @ weights[2].T) * (a > 0)
            step += 1
            for w, m, v, grad in zip(weights, first, second, (x[own].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit(x: np.ndarray, partitions: int = PARTITIONS, recall: float = RECALL, seed: int = 7) -> Router:
    """Graph, partitions, classifier and the mass to probe from the sample's unit vectors."""
    rng = np.random.default_rng(seed)
    x = unit(x)
    near = neighbours(x, NEIGHBOURS)
    part = cut_graph(x, near, partitions, rng)
    n_parts = int(part.max()) + 1
    target = np.zeros((len(x), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += 1
    target /= target.sum(1, keepdims=True)
    held = rng.permutation(len(x))[: min(len(x) // 5, 1000)]
    rest = np.setdiff1d(np.arange(len(x)), held)
    router = train(x[rest], target[rest], rng)
    if len(held):
        # As for rows at large: neighbours lie where the classifier puts them.
        places, (order, before) = router.partition(x), router.ranked(x[held])
        there = np.stack([(places[nb][None, :] == row[:, None]).sum(1) for row, nb in zip(order, near[held], strict=True)])
        masses = [*np.linspace(0.3, 0.99, 70), *(1 - np.logspace(-2, -6, 9)), 2.0]
        router.mass = next((m for m in masses if there[before < m].sum() >= recall * near[held].size), 2.0)
    return router


def partitions_for(rows: int, sample: int = SAMPLE) -> int:
    """A power of two, as partitions come from halves; no more than the sample can teach."""
    want = PARTITIONS
    while want * 2 * TEACHERS <= sample and rows > want * PARTITION_ROWS:
        want *= 2
    return want


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, partitions: int | None = None, recall: float = RECALL, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k nearest found."""
    spark = embeddings.sparkSession
    shared.slim(spark)
    rows = usable(embeddings).where(F.exists("v", lambda x: x != 0))
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v", "dim").toArrow()
    if not seen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = seen["dim"].to_numpy()
    dim = int(np.bincount(dims).argmax())
    router = fit(matrix(seen["v"].filter(dims == dim)), partitions or partitions_for(rows.count(), sample), recall)
    del seen

    @pandas_udf("array<int>")
    def routes(v: pd.Series) -> pd.Series:
        out = [[-1]] * len(v)
        own = [i for i, x in enumerate(v) if len(x) == dim]
        if own:
            for i, r in zip(own, router.routes(unit(np.array([v.iloc[i] for i in own]))), strict=True):
                out[i] = r
        return pd.Series(out)

    @pandas_udf("int")
    def partition(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1, np.int32)
        own = [i for i, x in enumerate(v) if len(x) == dim]
        if own:
            out[own] = router.partition(unit(np.array([v.iloc[i] for i in own])))
        return pd.Series(out)

    index = shared.kept(rows.withColumn("part", partition("v")), "index")
    out = shared.folder(spark, "blocks")

    def store(own: pd.DataFrame) -> pd.DataFrame:
        d, p, b = (int(own[c].iloc[0]) for c in ("dim", "part", "block"))
        sink = pa.BufferOutputStream()
        for batch in (pa.record_batch({"id": own["vec_id"].to_numpy(np.int64)}), pa.record_batch({"v": stack(own["v"], d).ravel()})):
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
        shared.put(f"{out}/{d}-{p}-{b}.block", sink.getvalue().to_pybytes())
        return pd.DataFrame({"dim": [d], "part": [p], "block": [b]})

    blocks, last = salted(index, ["dim", "part"], block_rows, "block")
    shared.kept(apart(blocks, "dim", "part", "block").groupBy("dim", "part", "block").applyInPandas(store, "dim int, part int, block int"), "blocks-done")
    last = shared.kept(last, "blocks-last")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    probes = shared.kept(asked.withColumn("part", F.explode(routes("v"))), "probes")
    dealt, _ = salted(probes, ["dim", "part"], query_rows, "share")
    keys = ["dim", "part", "share", "first", "final"]
    spread = apart(groups(dealt, ["dim", "part"], last, group), *keys)

    def rank(queries: pd.DataFrame) -> pd.DataFrame:
        d, p, first, final = (int(queries[c].iloc[0]) for c in ("dim", "part", "first", "final"))
        asks, q = queries["vec_id"].to_numpy(np.int64), stack(queries["v"], d)
        best: list[list[tuple[float, int]]] = [[] for _ in asks]
        for b in range(first, final + 1):
            source = pa.BufferReader(shared.get(f"{out}/{d}-{p}-{b}.block"))
            ids, flat = (pa.ipc.open_stream(source).read_all() for _ in range(2))
            ids, x = ids["id"].to_numpy(), flat["v"].to_numpy().reshape(len(ids), d)
            rough = unit(q) @ unit(x).T
            for i, qid in enumerate(asks.tolist()):
                s = rough[i]
                s[ids == qid] = -np.inf
                floor = np.partition(s, len(s) - k)[len(s) - k] - 1e-9 if len(s) > k else -np.inf
                if len(best[i]) == k:
                    floor = max(floor, -best[i][-1][0] - 1e-9)
                pick = np.flatnonzero((s >= floor) & (s > -np.inf))
                if len(pick):
                    best[i] = sorted(best[i] + list(zip((-cosine(q[i], x[pick])).tolist(), ids[pick].tolist(), strict=True)))[:k]
        found = [(qid, i, -s) for qid, own in zip(asks.tolist(), best, strict=True) for s, i in own]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = spread.groupBy(*keys).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each in the same order of additions whatever stands beside it."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        plain = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
    odd = ~np.isfinite(plain)
    if odd.any():  # squares that leave the range of doubles
        a, b = unit(x[odd]), unit(q[None, :])
        plain[odd] = (a * b).sum(1)
    return plain
