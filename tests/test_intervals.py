"""Interval lookup and hints against plain models."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from codeweave.operators import intervals

NODES, PROBES = "id string, file_path string, start_line int, end_line int", "probe int, file_path string, line int"


def best(nodes, probes, top, at):
    out = set()
    for probe, key, line in probes:
        found = []
        for id_, path, start, end in nodes:
            if start is not None and line is not None and at(path, key) and start <= line:
                encloses = end is not None and end >= line and end > start
                found.append((end - start if encloses else 999_999, -start, id_, encloses))
        out |= {(probe, id_, span, encloses, rank) for rank, (span, _, id_, encloses) in enumerate(sorted(found)[:top], 1)}
    return out


def same(a, b):
    return a is not None and a == b


@pytest.mark.parametrize("seed,top,deep,few", [(1, 3, 64, 0), (2, 1, 64, 42), (3, 3, 2, 0), (4, 5, 0, 45), (5, 3, 64, 999)])
def test_lookup_of_any_spans(spark, seed, top, deep, few):
    rng = random.Random(seed)
    nodes, probes = [], []
    for i in range(160):
        start = rng.choice([rng.randint(1, 60), rng.randint(1, 5000), rng.randint(0, 3) << 22])
        end = rng.choice([start, start + rng.randint(0, 9), start + rng.randint(0, 3000), None, start - 1, start + 1_500_000])
        nodes.append((f"n{i}", f"f{rng.randrange(4)}", None if i % 40 == 7 else start, end))
    nodes += [(f"m{i}", "f1", 30, 30 + i % 3) for i in range(12)]
    for i in range(200):
        probes.append((i, rng.choice(["f0", "f1", "f2", "f3", "none", None]), rng.choice([0, rng.randint(1, 70), rng.randint(1, 6000), 1 << 22, (1 << 31) - 1, None])))
    got = intervals.at_line(spark.createDataFrame(nodes, NODES).repartition(3), spark.createDataFrame(probes, PROBES), top, ["file_path"], deep, few)
    assert {tuple(r) for r in got.select("probe", "id", "span", "encloses", "rank").collect()} == best(nodes, probes, top, same)


def test_rows_read_are_as_deep_as_the_nesting(spark):
    nodes, at = [], 1
    for c in range(10_000):  # a file of 100,000 spans, three deep
        nodes += [(f"c{c}", "big", at, at + 29), *[(f"m{c}.{m}", "big", at + 3 * m + 1, at + 3 * m + 3) for m in range(9)]]
        at += 30
    table = spark.createDataFrame([("file", "big", 1, at), *nodes], NODES)
    probes = spark.createDataFrame([(i, "big", 1 + (i * 7919) % at) for i in range(500)], PROBES)
    kept = intervals.states(table, ["file_path"])
    met = intervals.located(kept, probes, ["file_path"])
    assert met.count() == 500 and met.agg(F.max(F.size("spans"))).first()[0] <= 3 + 5
    by = {r["probe"]: (r["id"], r["line"]) for r in intervals.at_line(table, probes, 1, ["file_path"]).collect()}
    spans = {n[0]: n[2:] for n in nodes}
    assert len(by) == 500 and all(spans[i][0] <= line <= spans[i][1] for i, line in by.values())


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_hints_of_any_length(spark):
    rng = random.Random(5)
    paths = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["src/main/Ünï.java", "", None]
    nodes = [(f"n{i}", p, 1, 5) for i, p in enumerate(paths)]
    hints = ["", "a", "/", "ab", "b/a", "nï.j", "main/Ü", "main/Ünï.java", "src/main/Ünï.javax", "zz", None, *["".join(rng.choice("ab/") for _ in range(n)) for n in range(1, 13)]]
    probes = [(i, h, 3) for i, h in enumerate(hints)]
    asked = spark.createDataFrame(probes, "probe int, file_hint string, line int")
    found = intervals.matched(spark.createDataFrame(nodes, NODES), asked)
    got = sorted((r["probe"], r["file_path"]) for r in found.collect())
    assert got == sorted({(i, p) for i, h, _ in probes for p in paths if h is not None and p is not None and h in p})
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    looked = intervals.at_line(spark.createDataFrame(nodes, NODES), asked, 2)
    assert {tuple(r) for r in looked.select("probe", "id", "span", "encloses", "rank").collect()} == best(nodes, probes, 2, lambda p, h: p is not None and h is not None and h in p)
    assert intervals.matched(spark.createDataFrame(nodes, NODES), asked.limit(0)).count() == 0


def test_batch_lookup_keeps_what_is_not_found(spark):
    nodes = spark.createDataFrame([("a", "f", 5, 9)], NODES)
    probes = spark.createDataFrame([(1, "f", 6), (2, "f", 4), (3, "g", 6), (4, None, None)], PROBES)
    assert {(r["probe"], r["id"], r["found"]) for r in intervals.batch_lookup(nodes, probes, ["file_path"]).collect()} == {(1, "a", True), (2, None, False), (3, None, False), (4, None, False)}
