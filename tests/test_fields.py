"""Full-text search over fields against a plain scorer."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweave.operators import fields, search
from codeweave.operators.fields import FieldIndex

WEIGHTS = {"name": 2.0, "file_path": 1.0, "first_line": 1.0, "documentation": 0.5, "source_code": 1.0}
SCHEMA = "id string, name string, file_path string, first_line string, documentation string, source_code string, term string, level int"


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "Delta", "rare1", *[f"w{i}" for i in range(40)]]
    weights = [30, 20, 5, 5, 0.2, *[3] * 40]

    def text(most):
        return rng.choice([None, ""]) if rng.random() < 0.15 else " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, most)))

    return [(f"d{i:04d}", text(2), text(3), text(6), text(10), text(rng.choice([5, 60])), "x", 1) for i in range(n)]


def plain(docs, terms, k):
    terms, score = sorted({t.lower() for t in terms}), Counter()
    for j, (_, weight) in enumerate(WEIGHTS.items(), 1):
        words = {d[0]: re.findall(r"\w+", (d[j] or "").lower()) for d in docs}
        mean = max(sum(map(len, words.values())) / len(docs), 1e-9)
        for t in terms:
            tf = {i: w.count(t) for i, w in words.items() if t in w}
            idf = math.log(1 + (len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, n in tf.items():
                score[i] += weight * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("seed,block", [(1, 128), (2, 3)])
def test_search_equals_a_plain_scorer(spark, tmp_path, seed, block):
    own = rows(seed, 300)
    docs = spark.createDataFrame([*own, (None, *own[0][1:])], SCHEMA).repartition(4)
    index = FieldIndex.build(docs, str(tmp_path / "index"), WEIGHTS, block)
    for terms, k in ((["alpha"], 7), (["alpha", "RARE1", "w3"], 10), (["delta", "gamma", "beta", "alpha"], 25), (["none"], 5), ([], 5), (["w1", "w2"], 1000), (["beta"], 0)):
        got = [(r["id"], r["score"]) for r in index.search(docs.where("id IS NOT NULL"), terms, k, first=20).collect()]
        want = plain(own, terms, k)
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-8 for g, w in zip(got, want, strict=True))


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    rng = random.Random(4)
    own = [(f"d{i:04d}", "common" if i % 400 == 0 else "other", "a/b", "x", "y", " ".join(["common"] * rng.randint(0, 3) + ["filler"] * rng.randint(1, 40)), "x", 1) for i in range(4000)]
    docs = spark.createDataFrame(own, SCHEMA)
    index = FieldIndex.build(docs, str(tmp_path / "index"), WEIGHTS, 16)
    got = [r["id"] for r in index.search(docs, ["common"], 5, first=32).collect()]
    assert got == [i for i, _ in plain(own, ["common"], 5)]
    assert 0 < index.read < index.held / 4
    widest = spark.read.parquet(f"{index.folder}/blocks").selectExpr("max(size(entries))").first()[0]
    assert widest < 6 * 16  # blocks are bounded, whatever a term's frequency


def test_a_repository_is_chosen_from_the_pool(spark, tmp_path):
    own = rows(3, 200)
    docs = spark.createDataFrame(own, SCHEMA)
    index = FieldIndex.build(docs, str(tmp_path / "index"), WEIGHTS)
    mine = docs.where("id < 'd0060'")
    got = [r["id"] for r in fields.scoped_search(index, docs, ["alpha", "w3"], 3, mine).collect()]
    assert got == [i for i, _ in plain(own, ["alpha", "w3"], 50) if i < "d0060"][:3]
    assert FieldIndex.build(docs.limit(0), str(tmp_path / "none"), WEIGHTS).search(docs.limit(0), ["alpha"], 3).count() == 0


def test_texts_are_dealt_to_tasks_before_they_are_cut(spark, tmp_path):
    docs = spark.createDataFrame(rows(5, 200), SCHEMA).coalesce(1)
    index = FieldIndex.build(docs, str(tmp_path / "index"), WEIGHTS)
    assert len(spark.read.parquet(f"{index.folder}/entries").inputFiles()) > 1
    held = {(r["field"], r["term"], r["id"]): r["tf"] for r in spark.read.parquet(f"{index.folder}/entries").collect()}
    want = Counter((f, t, d[0]) for d in rows(5, 200) for j, f in enumerate(WEIGHTS, 1) for t in re.findall(r"\w+", (d[j] or "").lower()))
    assert held == want


def test_terms_are_counted_without_being_grouped(spark):
    texts = [(1, "b a B, a b"), (2, ""), (3, None), (4, "é ß É x1 x1"), (5, "--"), (None, "a")]

    def found(own):
        docs = spark.createDataFrame(own, "id long, text string")
        got = search.postings(docs, "id", F.col("text"))
        return got, sorted(((r["id"], r["term"], r["tf"], r["len"]) for r in got.collect()), key=str)

    got, counts = found(texts)
    want = [(1, "a", 2, 5), (1, "b", 3, 5), (4, "x1", 2, 5), (4, "ß", 1, 5), (4, "é", 2, 5), (None, "a", 1, 1)]
    assert counts == sorted(want, key=str)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    # An id that comes twice is one document, as before.
    assert found([*texts, (1, "a c"), (None, "a")])[1] == sorted([(1, "a", 3, 5), (1, "b", 3, 5), (1, "c", 1, 2), *want[2:5], (None, "a", 2, 1)], key=str)
