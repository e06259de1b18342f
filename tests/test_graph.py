"""Graph operators against plain models."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codeweave.operators import fusion, intervals, resolve, search, stats, traverse, upsert
from codeweave.plans import diagnose, lenses, retrieve


def graph(spark, seed, n=12, m=30):
    rng = random.Random(seed)
    kinds = ["METHOD", "FUNCTION", "CLASS"]
    nodes = [(f"n{i}", rng.choice(kinds), f"name{i % 4}", f"f{i % 3}", f"r{i % 2}") for i in range(n)]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["CALLS", "CALLS", "CONTAINS"]), rng.choice([None, 0.4, 0.5, 0.9])) for _ in range(m)]
    return nodes, edges, spark.createDataFrame(nodes, "id string, type string, name string, file_path string, repo_name string"), spark.createDataFrame(edges, "source string, target string, type string, confidence double")


def walk(edges, seeds, hops, inbound=False):
    found, level = {}, set(seeds)
    for d in range(1, hops + 1):
        level = {(a if inbound else b) for a, b in edges if (b if inbound else a) in level}
        for x in level:
            found.setdefault(x, d)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_traversal(spark, seed):
    nodes, edges, ndf, edf = graph(spark, seed)
    kind, repo = {n[0]: n[1] for n in nodes}, {n[0]: n[4] for n in nodes}
    calls = [(a, b) for a, b, t, _ in edges if t == "CALLS"]
    sure = [(a, b) for a, b, t, c in edges if t == "CALLS" and (c or 0) >= 0.5]
    seeds = spark.createDataFrame([("n0",), ("n1",)], "id string")
    got = {tuple(r) for r in traverse.calls_graph(ndf, edf, seeds, 9, "r0").select("id", "direction", "distance").collect()}
    want = {(x, d, n) for d, inbound in (("callee", False), ("caller", True)) for x, n in walk(sure, ["n0", "n1"], 3, inbound).items() if kind[x] != "CLASS" and repo[x] == "r0" and x not in ("n0", "n1")}
    assert got == want
    assert {(r["id"], r["distance"]) for r in traverse.callers(ndf, edf, "n2", 9).collect()} == set(walk(calls, ["n2"], 4, True).items())
    assert {(r["id"], r["distance"]) for r in traverse.callees(ndf, edf, "n2", 0).collect()} == set(walk(calls, ["n2"], 1).items())
    counts = {r["id"]: (r["callers"], r["callees"]) for r in traverse.call_counts(ndf, edf, spark.createDataFrame([(f"n{i}",) for i in range(14)], "id string")).collect()}
    assert counts == {n[0]: (len({a for a, b in calls if b == n[0]}), len({b for a, b in calls if a == n[0]})) for n in nodes}


def test_call_resolution(spark):
    nodes = spark.createDataFrame([("a", "METHOD", "one", "f1", "r"), ("b", "METHOD", "two", "f1", "r"), ("c", "FUNCTION", "two", "f2", "r"), *[(f"m{i}", "METHOD", "many", f"g{i}", "r") for i in range(4)], ("k", "CLASS", "one", "f1", "r"), ("z", "METHOD", "one", "f1", "other")], "id string, type string, name string, file_path string, repo_name string")
    refs = spark.createDataFrame([("s", "one", "x", "r", 0.6), ("s", "two", "f2", "r", None), ("s", "many", "x", "r", None), ("s", "none", "x", "r", None)], "source string, target_name string, file_path string, repo_name string, confidence double")
    got = {(r["target"], r["confidence"], r["resolution"]) for r in resolve.resolve_calls(refs, nodes).collect()}
    assert got == {("a", 0.6, "heuristic"), ("c", 0.4, "heuristic"), ("m0", 0.4, "heuristic"), ("m1", 0.4, "heuristic"), ("m2", 0.4, "heuristic")}
    types = spark.createDataFrame([("s", "one", "EXTENDS", "r"), ("s", "many", "EXTENDS", "r")], "source string, target_name string, type string, repo_name string")
    assert [r["target"] for r in resolve.resolve_unique(types, nodes).collect()] == ["k"]


def test_calls_meet_lists_of_namesakes(spark):
    many = 2 * 1024 + 1
    nodes = [(f"a{i:05}", "FUNCTION", "f", "a", "r") for i in range(many)] + [("b", "METHOD", "f", "b", "r"), ("c", "METHOD", "f", None, "r"), ("d", "METHOD", "g", None, "r"), ("e", "METHOD", "g", "e", "r")]
    refs = [("s1", "f", "a"), ("s2", "f", "b"), ("s3", "f", None), ("s4", "f", ""), ("s5", "f", "x"), ("s1", "g", "a"), ("s2", "g", "e"), ("s3", None, "a")]
    want = sorted([("s1", f"a{i:05}") for i in range(many)] + [("s2", "b"), ("s1", "d"), ("s1", "e"), ("s2", "e")] + [(s, f"a{i:05}") for s in ("s3", "s4", "s5") for i in range(3)])
    ndf = spark.createDataFrame(nodes, "id string, type string, name string, file_path string, repo_name string")
    rdf = spark.createDataFrame([(*r, "r") for r in refs], "source string, target_name string, file_path string, repo_name string")
    for given in ({}, {"unique": True, "parts": 3}):
        edges = resolve.resolve_calls(rdf, ndf, **given).select("source", "target")
        assert sorted(map(tuple, edges.collect())) == want
        plan = edges._jdf.queryExecution().executedPlan().toString()
        # Lists are unrolled after the join, and both kinds of edges come from the same shuffled references.
        assert "Generate explode(_targets" in plan and "ReusedExchange [source" in plan, plan


def test_interval_lookup(spark):
    nodes = spark.createDataFrame([("file", "src/a.py", 1, 100), ("cls", "src/a.py", 10, 60), ("fn", "src/a.py", 20, 30), ("line", "src/a.py", 25, 25), ("late", "src/a.py", 70, 80)], "id string, file_path string, start_line int, end_line int")
    probes = spark.createDataFrame([(1, "a.py", 25), (2, "a.py", 65), (3, "b.py", 5), (4, "A.py", 25)], "probe int, file_hint string, line int")
    got = {}
    for r in intervals.at_line(nodes, probes).orderBy("probe", "rank").collect():
        got.setdefault(r["probe"], []).append((r["id"], r["span"]))
    assert got == {1: [("fn", 10), ("cls", 50), ("file", 99)], 2: [("file", 99), ("line", 999999), ("fn", 999999)]}
    assert {(r["probe"], r["id"], r["found"]) for r in intervals.batch_lookup(nodes, probes).collect()} == {(1, "fn", True), (2, "file", True), (3, None, False), (4, None, False)}


def test_fusion(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    calls = fusion.call_scores(d([("x", "callee", 1), ("x", "caller", 1), ("y", "caller", 2), ("s", "callee", 5)], "id string, direction string, distance int"))
    fused = fusion.fuse(d([("e",)], "id string"), d([("s", 0.5), ("e", 0.9)], "id string, score double"), d([("l", 0.85), ("s", 0.3)], "id string, score double"), calls)
    assert {r["id"]: round(r["score"], 6) for r in fused.collect()} == {"e": 1.0, "s": 0.6, "l": 0.85, "x": 0.25, "y": 0.1}


def test_seeds_never_get_the_bonus_of_calls(spark):
    _, _, nodes, edges = graph(spark, 5)
    exact = spark.createDataFrame([], "id string")
    semantic = spark.createDataFrame([("n0", 0.5), ("n1", 0.4)], "id string, score double")
    got = retrieve.retrieve(nodes, edges, exact, semantic, semantic.limit(0), depth=3, limit=50)
    assert {r["score"] for r in got.where("id IN ('n0', 'n1')").collect()} <= {0.5, 0.4}


def test_merges(spark):
    base = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "id string, p string, q string")
    delta = spark.createDataFrame([("a", "3", None, 1), ("a", None, "z", 2), ("c", "5", None, 1)], "id string, p string, q string, batch int")
    assert {tuple(r) for r in upsert.merge_nodes(base, delta, ["batch"]).collect()} == {("a", "3", "z"), ("b", "2", "y"), ("c", "5", None)}
    edges = spark.createDataFrame([("a", "T", "b", 0.1), ("a", "T", "c", 0.2)], "source string, type string, target string, confidence double")
    new = spark.createDataFrame([("a", "T", "b", 0.9)], "source string, type string, target string, confidence double")
    assert {tuple(r) for r in upsert.merge_edges(edges, new).select("source", "target", "confidence").collect()} == {("a", "b", 0.9), ("a", "c", 0.2)}


def test_evidence_entities(spark):
    rows = spark.createDataFrame([("i", "r", "svc", "/a", "d1", "v1", None), ("j", None, None, "/a", None, None, "db")], "id string, repo_name string, service string, route string, deployment_id string, version string, dependency string")
    entities, links = upsert.evidence_entities(rows)
    assert {(r["id"], r["label"], r["version"]) for r in entities.collect()} == {("r::service::svc", "Service", None), ("r::service::svc::route::/a", "Route", None), ("::route::/a", "Route", None), ("r::deployment::d1", "Deployment", "v1"), ("::dependency::db", "Dependency", None)}
    assert links.count() == 5


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "repo_name string, made_causal_claim boolean, resolved_correctly boolean, expected_cause_identified boolean, supported_by_evidence boolean, latency_ms double, cost_usd double")
    assert tuple(stats.evaluation_metrics(none).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_full_text_terms(spark):
    df = spark.createDataFrame([("Why does OrderService fail? why fail the OrderService número 12345 x",), ("a bc",)], "q string")
    assert [r[0] for r in df.select(search.full_text_query(F.col("q"))).collect()] == ["OrderService OR número OR 12345 OR does OR fail", ""]


def test_place_of_a_failure(spark):
    java = "x.BadException: no\n\tat a.b.Foo.run(Foo.java:12)"
    assert diagnose.place(spark, "q", trace=java) == ("Foo.java", 12)
    assert diagnose.place(spark, "see Bar.ts:7 and line 3 in Baz") == ("Bar.ts", 7)
    assert diagnose.place(spark, "q", file="A.java", line=3, trace=java) == ("A.java", 3)
    assert diagnose.place(spark, "nothing here") == (None, None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hub", [1_000_000, 3])
def test_walks_over_buckets(spark, hub):
    nodes, edges, ndf, edf = graph(spark, 7, 30, 120)
    kept = traverse.adjacency(edf, hub)
    assert (kept.hubs_out is None) == (hub > 3)
    seeds = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "id string")
    assert {tuple(r) for r in traverse.calls_graph(ndf, kept, seeds, 3).select("id", "direction", "distance").collect()} == {tuple(r) for r in traverse.calls_graph(ndf, edf, seeds, 3).select("id", "direction", "distance").collect()}
    calls = [(a, b) for a, b, t, _ in edges if t == "CALLS"]
    assert {(r["id"], r["distance"]) for r in traverse.callers(ndf, kept, "n2", 4).collect()} == set(walk(calls, ["n2"], 4, True).items())
    every = spark.createDataFrame([(n[0],) for n in nodes], "id string")
    assert sorted(map(tuple, traverse.call_counts(ndf, kept, every).collect())) == sorted(map(tuple, traverse.call_counts(ndf, edf, every).collect()))
    kept.drop()


def test_hops_over_buckets_move_no_edges(spark):
    _, _, ndf, edf = graph(spark, 9, 40, 200)
    kept = traverse.adjacency(edf)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for inbound in (False, True):
            plan = plan_of(traverse.walk(kept.where("type = 'CALLS'"), ndf.select("id"), 3, inbound)).split("\n")
            scans = [i for i, line in enumerate(plan) if "FileScan" in line and "adjacency" in line]
            assert len(scans) >= 3 and "Bucketed: true" in plan[scans[-1]]
            for i in scans[1:]:  # between a scan and the join above it is no exchange
                above = next(j for j in range(i, -1, -1) if "Join" in plan[j])
                assert not any("Exchange" in line for line in plan[above:i])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        kept.drop()


def brute_paths(edges, seeds, hops):
    out, level = set(), [(s,) for s in seeds]
    for d in range(1, hops + 1):
        level = [(*p, b) for p in level for a, b in edges if a == p[-1] and (a, b) not in list(zip(p, p[1:], strict=False))]
        out |= {(p[-1], p, d) for p in level}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_paths_and_ancestors(spark, seed):
    rng = random.Random(seed)
    edges = list({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(16)} | {("hub", f"n{i}") for i in range(9)} | {(f"n{i}", "hub") for i in range(0, 9, 3)})
    edf = spark.createDataFrame([(a, b, "CALLS", 1.0) for a, b in edges for _ in range(1 + (a == b))] + [("n0", "x", "OTHER", 1.0)], "source string, target string, type string, confidence double")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "id string")
    want = brute_paths(edges, ["n0", "n1"], 4)
    got = [(r["id"], tuple(r["path"]), r["hops"]) for r in traverse.paths(edf, seeds, ["CALLS"], 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    ends = spark.createDataFrame([("hub",), ("n5",), ("none",)], "id string")
    assert {(r["id"], tuple(r["path"]), r["hops"]) for r in traverse.paths(edf, seeds, ["CALLS"], 4, ends).collect()} == {w for w in want if w[0] in ("hub", "n5")}
    for hops in (1, 2, 3, 6):
        near = {(n, x, d) for n in {a for a, _ in edges} for x, d in walk(edges, [n], hops).items()}
        assert {tuple(r) for r in traverse.ancestors(edf, ["CALLS"], hops).collect()} == near


def test_calls_are_dealt_by_their_number_before_they_are_combined(spark):
    from codeweave.operators import upsert
    from codeweave.plans import lenses
    from codeweave.sources.places import TASK_ROWS, parts_of

    least = 2 * spark.sparkContext.defaultParallelism
    assert parts_of(spark.range(10)) == least and parts_of(spark.range(40 * TASK_ROWS + 1)) == max(least, 41)
    calls = lenses.calls(spark, "/root/testdata/sf0.001")
    for piece in calls._jdf.queryExecution().executedPlan().toString().split("FileScan")[:-1]:
        assert "Aggregate" not in piece.rpartition("Exchange")[2]
    base = spark.createDataFrame([("a", "b", "CALLS", 0.5), ("a", "c", "CALLS", 0.5)], "source string, target string, type string, confidence double")
    delta = spark.createDataFrame([("a", "b", "CALLS", 0.7), ("d", "c", "CALLS", 0.1)], base.schema)
    assert sorted(upsert.merge_edges(base, delta, partitions=3).collect()) == sorted(upsert.merge_edges(base, delta).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_partitions_of_a_kept_lens_go_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lenses, "_KEPT", {})
    monkeypatch.setattr(lenses, "call_parts", lambda spark, d: 40)
    kept = lenses.kept(spark, "/root/testdata/sf0.001", lenses.edges)
    assert kept.rdd.getNumPartitions() == 40
    kept.unpersist()
