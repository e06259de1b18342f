"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.operators import search, vector_index
from codeweave.operators.vector_index import VectorIndex, scoped_search
from codeweave.plans import retrieve


def clustered(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [[float(x) for x in centres[i % groups] + 0.35 * rng.normal(size=dims)] for i in range(n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(f"v{i:05d}", v) for i, v in enumerate(clustered(6000, 32, 60, 1))]
    odd = [("null", None), ("short", [1.0]), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32), ("inf", [float("inf")] + [0.0] * 31), ("hole", [None] + [1.0] * 31), ("empty", [])]
    table = spark.createDataFrame(rows + odd, "id string, embedding array<float>").repartition(5)
    folder = str(tmp_path_factory.mktemp("vectors") / "index")
    return rows, table, VectorIndex.build(table, folder), folder


def exact(rows, q, n):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    q = np.array(q)
    score = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return [(rows[i][0], float(score[i])) for i in np.lexsort((np.arange(len(rows)), -score))[:n]]


def test_full_probe_is_exact(spark, made):
    rows, table, index, folder = made
    assert index.table().count() == 6000 and len(index.model.centres) == 77
    q = rows[17][1]
    for found in (index.candidates(q, 20, 77, None), VectorIndex.open(spark, folder).candidates(q, 20, 77, None)):
        got = [(r["id"], r["score"]) for r in found.collect()]
        want = exact(rows, q, 20)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_recall_of_the_usual_search(spark, made):
    rows, _, index, _ = made
    hit = 0
    for i in range(0, 6000, 250):
        q = [x + 0.05 for x in rows[i][1]]
        got = {r["id"] for r in index.candidates(q, 10).collect()}
        hit += len(got & {w[0] for w in exact(rows, q, 10)})
    assert hit / 240 >= 0.9


def test_a_search_reads_the_probed_cells_alone(spark, made):
    _, _, index, _ = made
    cells = index.model.nearest_cells(np.ones(32) / np.sqrt(32), 3)
    rows = index.table().where(F.col("cell").isin(cells))
    assert "PartitionFilters: [cell" in rows._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(rows.inputFiles()) and rows.count() < 6000 * 0.3


def test_a_repository_gets_no_more_than_the_pool(spark, made):
    rows, table, index, _ = made
    q = rows[3][1]
    own = table.where("id < 'v03000'")
    for source in (index, table):
        got = [r["id"] for r in scoped_search(source, q, 3, own, -1.0, 77, None).collect()]
        assert got == [w for w, _ in exact(rows, q, 50) if w < "v03000"] and len(got) < 50
        assert len(scoped_search(source, q, 8, own.limit(0), -1.0, 77, None).collect()) == 0
        assert [r["id"] for r in scoped_search(source, q, 3, None, -1.0, 77, None).collect()] == [w for w, _ in exact(rows, q, 3)]
    assert vector_index.pool(3, True) == 50 and vector_index.pool(8, True) == 80 and vector_index.pool(8, False) == 8


def test_seeds_of_a_repository_are_bounded(spark, made):
    rows, table, index, _ = made
    nodes = table.select("id", F.lit("METHOD").alias("type"), F.col("id").alias("name"), F.lit("q").alias("qualified_name"), F.lit("f").alias("file_path"), F.lit("r").alias("repo_name"), F.lit("").alias("first_line"), F.lit("").alias("source_code"))
    for source in (table, index):
        _, semantic, _ = retrieve.seeds(nodes, source, "of", repo="r", vector=rows[5][1])
        assert 0 < semantic.count() <= 50


def test_index_of_little_and_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    index = VectorIndex.build(none, str(tmp_path / "none"))
    assert index.model.dims == 1
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "id long, embedding array<float>")
    index = VectorIndex.build(few, str(tmp_path / "few"))
    assert [r["id"] for r in index.candidates([1.0, 0.1], 5).collect()] == [1, 2]
    assert index.candidates([0.0, 0.0], 5).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        index.candidates([1.0], 1)
    assert search.vector_search(few, [1.0, 0.1], -1.0, 1).first()["id"] == 1


def test_batch_search_finds_what_a_table_search_finds_with_copies_and_ties(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(f"v{i:04d}", base[i % 40].tolist()) for i in range(1300)] + [("zero", [0.0] * 8), ("null", None)]
    table = spark.createDataFrame(rows, "id string, embedding array<float>")
    found = VectorIndex.build(table, f"{tmp_path}/copies", 4, 2)
    asked = [(q, base[q % 7].astype(float).tolist()) for q in range(30)] + [(98, [0.0] * 8), (99, None)]
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")
    got = {q: [] for q, _ in asked}
    for r in found.nearest(queries, 45, probes=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    assert not got[98] and not got[99]
    for q in range(7):
        want = [r["id"] for r in search.vector_search(table, asked[q][1], k=45).collect()]
        assert len(want) >= 32 and all(got[p] == want for p in range(q, 30, 7))


def test_batch_search_compares_equal_vectors_once(spark, tmp_path):
    # 600 million pairs of rows, and one pair of vectors.
    table = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    found = VectorIndex.build(table, f"{tmp_path}/equal", 1, 1)
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert found.nearest(queries, 3).groupBy("id").count().orderBy("id").collect() == [("0", 20_000), ("1", 20_000), ("10", 20_000)]
