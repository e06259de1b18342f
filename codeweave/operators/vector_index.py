"""A vector index: an inverted file with product quantisation.

Vectors of unit length are dealt to cells, by the nearest of some centres; a cell is a folder, so a search reads those of the cells nearest to its query
alone (partition pruning). Within a cell a vector is told by its difference from the centre, in short pieces, each replaced by the
number of the nearest of at most 256 patterns: a score of all vectors read takes a look-up for each piece. The best of these
are scored exactly on their vectors.

Centres and patterns are learned from at most `SAMPLE` vectors; all are indexed. Vectors that are null, zero, of other length than most or have
components that are null or not finite are no part of an index, and are found by no search.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.places import spread, stored
from . import search
from .ranking import top_of

#: Vectors that are learned from, for each cell and at most; rounds of learning; patterns of a piece.
PER_CELL, SAMPLE, ROUNDS, PATTERNS = 64, 40_000, 12, 256
#: What is scored exactly for each hit that is asked for.
REFINE = 20
#: Queries and rows of the blocks that are compared, parts that a cell's rows are dealt to, and rows that a task holds before it closes blocks.
QUERIES, ROWS, PARTS, HELD = 128, 512, 4, 32_768


@dataclass(frozen=True)
class Model:
    """centres (cells x dims) and patterns (pieces x patterns x dims / pieces)."""

    centres: np.ndarray
    patterns: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of vectors of unit length, and the numbers of their pieces."""
        cells = np.argmax(vectors @ self.centres.T, axis=1)
        rest = (vectors - self.centres[cells]).reshape(len(vectors), len(self.patterns), -1)
        far = np.stack([((rest[:, i, None, :] - p[None]) ** 2).sum(-1) for i, p in enumerate(self.patterns)], axis=1)
        return cells, far.argmin(-1).astype(np.int16)

    def nearest_cells(self, query: np.ndarray, probes: int) -> list[int]:
        return np.argsort(-(self.centres @ query), kind="stable")[:probes].tolist()


def _means(rows: np.ndarray, n: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """n centres by Lloyd's rounds; an empty one takes the row that lies worst."""
    centres = rows[rng.choice(len(rows), n, replace=len(rows) < n)].copy()
    for _ in range(ROUNDS):
        far = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None]
        own = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=n)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[np.argsort(-far.min(1))[np.arange(n) % len(rows)]])
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def usable(embeddings: DataFrame, dims: int) -> DataFrame:
    """The rows (id, embedding) that an index can hold, with `unit`, their vectors of length one in doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + v * v))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).withColumn("_x", x).withColumn("_n", norm)
    finite = F.col("_n").isNotNull() & (F.col("_n") > 0) & (F.col("_n") < float("inf")) & ~F.isnan("_n")
    return rows.where(finite).withColumn("unit", F.transform("_x", lambda v: v / F.col("_n"))).drop("_x", "_n")


def fit(embeddings: DataFrame, cells: int | None = None, pieces: int | None = None, seed: int = 0) -> Model:
    """A model of the rows (id, embedding): by default as many cells as the root of the number of rows, and a piece for four components."""
    sizes = embeddings.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None or not sizes["dims"]:
        return Model(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    dims, n = sizes["dims"], sizes["count"]
    cells = max(1, min(cells or round(math.sqrt(n)), SAMPLE // PER_CELL))
    pieces = pieces or next(p for p in range(max(1, dims // 4), 0, -1) if dims % p == 0)
    if dims % pieces:
        raise ValueError(f"{pieces} pieces of {dims} components")
    most = min(SAMPLE, max(PER_CELL * cells, 4 * PATTERNS))
    rows = usable(embeddings, dims).select("id", "unit")
    some = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), max(1, n // most)) == 0).limit(most) if n > most else rows
    sample = np.array([r["unit"] for r in some.orderBy("id").collect()], np.float64)  # at most `most` rows
    if not len(sample):
        return Model(np.zeros((1, dims)), np.zeros((1, 1, dims)))
    rng = np.random.default_rng(seed)
    centres = _means(sample, min(cells, len(sample)), rng, unit=True)
    rest = sample - centres[np.argmax(sample @ centres.T, axis=1)]
    patterns = [_means(np.ascontiguousarray(x), min(PATTERNS, len(sample)), rng) for x in np.split(rest, pieces, axis=1)]
    return Model(centres, np.stack(patterns))


class VectorIndex:
    """An index in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, model: Model) -> None:
        self.spark, self.folder, self.model = spark, folder, model

    @classmethod
    def build(cls, embeddings: DataFrame, folder: str, cells: int | None = None, pieces: int | None = None, seed: int = 0) -> VectorIndex:
        """Indexes the rows (id, embedding); ids are strings or numbers."""
        spark, model = embeddings.sparkSession, fit(embeddings, cells, pieces, seed)
        kind = dict(embeddings.dtypes)["id"]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    units = np.array(some.column("unit").to_pylist(), np.float64).reshape(some.num_rows, -1)
                    own, codes = model.encode(units)
                    yield pa.record_batch({"id": some.column("id"), "embedding": some.column("embedding").cast(pa.list_(pa.float32())), "codes": pa.array(list(codes), pa.list_(pa.int16())), "cell": pa.array(own.astype(np.int32))})

        rows = usable(spread(embeddings.select("id", "embedding"), "id"), model.dims).mapInArrow(encode, f"id {kind}, embedding array<float>, codes array<short>, cell int")
        # A cell's rows go to a few files: enough of them that a popular cell is no single task.
        rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{folder}/cells")
        spark.createDataFrame([(json.dumps({"centres": model.centres.tolist(), "patterns": model.patterns.tolist()}),)], "model string").coalesce(1).write.parquet(f"{folder}/model")
        return cls(spark, folder, model)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        held = json.loads(spark.read.parquet(f"{folder}/model").first()["model"])
        return cls(spark, folder, Model(np.array(held["centres"]), np.array(held["patterns"])))

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    def candidates(self, query: list[float], n: int, probes: int | None = None, refine: int | None = REFINE) -> DataFrame:
        """(id, score): the n vectors of the probed cells that are nearest to the query by cosine, best first, ties in order of id. `refine` times as
        many are chosen by their codes and then scored on their vectors; None scores all that are read."""
        q = np.array(query, np.float64)
        if len(q) != self.model.dims:
            raise ValueError(f"the index has {self.model.dims} dimensions, the query {len(q)}")
        norm = float(np.linalg.norm(q))
        if not norm:
            return self.table().select("id", F.lit(0.0).alias("score")).limit(0)
        cells = self.model.nearest_cells(q / norm, probes if probes is not None else self.usual_probes())
        rows = self.table().where(F.col("cell").isin(cells))
        if refine is not None:
            chosen = rows.select("id", self._coded(q / norm).alias("about"), "cell").orderBy(F.desc("about"), "id").limit(refine * n).collect()
            rows = rows.where(F.col("cell").isin(sorted({r["cell"] for r in chosen})) & F.col("id").isin([r["id"] for r in chosen]))
        vector = F.array(*[F.lit(float(x)) for x in query])
        return rows.select("id", search.cosine(F.col("embedding"), vector).alias("score")).orderBy(F.desc("score"), "id").limit(n)

    def nearest(self, queries: DataFrame, n: int, threshold: float = search.SEMANTIC_THRESHOLD, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): for each of the queries (query_id, vector) the n nearest vectors of its probed cells, scored on their vectors.
        Queries go to their cells; neither they nor the cells pass the driver. A null, zero or otherwise odd vector finds nothing."""
        model, many = self.model, probes if probes is not None else self.usual_probes()
        kinds = {"query": dict(queries.dtypes)["query_id"], "id": dict(self.table().dtypes)["id"]}
        rows = stored(usable(queries.select("query_id", F.col("vector").alias("embedding")), model.dims).select("query_id", "unit"), "queries")
        # Equal vectors are compared once: of a vector's rows only the n smallest ids can be among the n nearest.
        asked = stored(rows.groupBy("unit").agg(F.min("query_id").alias("first")), "asked")
        few = top_of(self.table().select("id", "embedding", "cell"), ["cell", "embedding"], [F.asc("id")], n)
        copies = stored(few.groupBy("cell", "embedding").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")), "copies")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    some = batch.slice(at, 1024)
                    units = np.array(some.column("unit").to_pylist(), np.float64).reshape(some.num_rows, -1)
                    cells = np.argsort(-(units @ model.centres.T), axis=1, kind="stable")[:, :many]
                    row = pa.array(np.repeat(np.arange(some.num_rows), cells.shape[1]))
                    yield pa.record_batch({"first": some.column("first").take(row), "vector": some.column("unit").take(row), "cell": pa.array(cells.ravel().astype(np.int32))})

        routed = asked.mapInArrow(route, f"first {kinds['query']}, vector array<double>, cell int")
        parts = F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part")
        left = _blocks(routed, kinds["query"], QUERIES).select("cell", parts, F.col("ids").alias("asks"), F.col("vectors").alias("q"))
        right = _blocks(copies.select("first", F.col("embedding").cast("array<double>").alias("vector"), "cell"), kinds["id"], ROWS)
        pairs = left.join(right.withColumn("part", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(PARTS)).cast("int")).hint("merge"), ["cell", "part"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q, x = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, model.dims) for c in ("q", "vectors"))
                    rough = (q @ x.T) / np.linalg.norm(x, axis=1)
                    least = np.full(len(q), threshold)
                    if len(x) > n:
                        least = np.maximum(least, np.partition(rough, len(x) - n, axis=1)[:, len(x) - n])
                    # Products of matrices round as they like; what is near enough is scored by itself.
                    a, b = np.nonzero(rough >= least[:, None] - 1e-9)
                    exact = (q[a] * x[b]).sum(1) / (np.sqrt((q[a] * q[a]).sum(1)) * np.sqrt((x[b] * x[b]).sum(1)))
                    yield pa.record_batch({"first": batch.column("asks")[i].values.take(pa.array(a)), "of": batch.column("ids")[i].values.take(pa.array(b)), "score": pa.array(exact, pa.float64())})

        scored = pairs.select("asks", "q", "ids", "vectors").mapInArrow(score, f"first {kinds['query']}, of {kinds['id']}, score double").where(F.col("score") >= threshold)
        best = scored.withColumn("_rank", F.rank().over(Window.partitionBy("first").orderBy(F.desc("score")))).where(F.col("_rank") <= n)
        named = best.join(copies.select(F.col("first").alias("of"), "ids").hint("merge"), "of").select("first", F.explode("ids").alias("id"), "score")
        hits = stored(top_of(named, ["first"], [F.desc("score"), F.asc("id")], n), "hits")
        return rows.join(asked.hint("merge"), "unit").select("query_id", "first").join(hits.hint("merge"), "first").select("query_id", "id", "score", "rank")

    def usual_probes(self) -> int:
        """A quarter of the cells, and eight at least."""
        return min(len(self.model.centres), max(8, len(self.model.centres) // 4))

    def _coded(self, unit: np.ndarray) -> F.Column:
        """The score of a row by its cell and codes."""
        pieces, patterns, width = self.model.patterns.shape
        table = np.einsum("pkw,pw->pk", self.model.patterns, unit.reshape(pieces, width))

        def values(x: np.ndarray) -> F.Column:
            return F.from_json(F.lit(json.dumps(x.ravel().tolist())), "array<double>")

        flat, centres = values(table), values(self.model.centres @ unit)
        return F.aggregate(F.transform("codes", lambda c, i: F.get(flat, i * patterns + c)), F.get(centres, F.col("cell")), lambda acc, x: acc + x)


def _blocks(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """(cell, ids, vectors): rows (first, vector, cell) in blocks of one cell, of `most` rows at most; vectors are doubles, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        count, of = 0, None

        def block(cell: int) -> pa.RecordBatch:
            ids, vectors = held.pop(cell)
            return pa.record_batch({"cell": pa.array([cell], pa.int32()), "ids": pa.array([ids], pa.list_(of)), "vectors": pa.array([np.concatenate(vectors).tobytes()], pa.binary())})

        for batch in batches:
            of = batch.column("first").type
            for first, vector, cell in zip(batch.column("first").to_pylist(), batch.column("vector"), batch.column("cell").to_pylist(), strict=True):
                ids, vectors = held.setdefault(cell, ([], []))
                ids.append(first)
                vectors.append(vector.values.to_numpy(zero_copy_only=False))
                count += 1
                if len(ids) == most:
                    count -= most
                    yield block(cell)
            if count >= HELD:
                yield from map(block, list(held))
                count = 0
        yield from map(block, list(held))

    return rows.select("first", "vector", "cell").mapInArrow(run, f"cell int, ids array<{kind}>, vectors binary")


def pool(k: int, scoped: bool) -> int:
    """Candidates of a search for k hits: where they are then held to one repository, ten times as many and 50 at least (fixed values)."""
    return max(10 * k, 50) if scoped else k


def scoped_search(source: DataFrame | VectorIndex, query: list[float], k: int, own: DataFrame | None = None, threshold: float = search.SEMANTIC_THRESHOLD, probes: int | None = None, refine: int | None = REFINE) -> DataFrame:
    """(id, score) of the vectors at least as near as the threshold, best first. With `own` (id), a repository's, they are those of the
    `pool` of candidates that are in it: at most so many, whatever the repository's size. From a table the candidates are exact."""
    n = pool(k, own is not None)
    found = source.candidates(query, n, probes, refine) if isinstance(source, VectorIndex) else search.vector_search(source, query, threshold, n)
    found = found.where(F.col("score") >= threshold)
    return (found if own is None else found.join(own.select("id"), "id", "left_semi")).orderBy(F.desc("score"), "id")
