"""Diagnosis of a table of reports against the diagnosis of one."""

import math

import pytest

from codeweave.operators import intervals, traverse, vector_index
from codeweave.operators.vector_index import VectorIndex
from codeweave.plans import diagnose, queries_reports, reports

NODES = "id string, type string, name string, file_path string, start_line int, end_line int, repo_name string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    nodes = [(f"n{i}", "METHOD" if i % 3 else "CLASS", f"do{i}", f"src/F{i % 4}.java", 10 * (i // 4) + 1, 10 * (i // 4) + 8, "r") for i in range(24)]
    nodes += [("t1", "METHOD", "do5Test", "src/test/T.java", 1, 5, "r"), ("t2", "METHOD", "do6", "src/test/U.java", 1, 5, "r"), ("t3", "METHOD", "do6", "src/test/V.java", 1, 5, "r"), ("t4", "METHOD", "do6", "src/test/W.java", 1, 5, "r")]
    edges = [(f"n{i}", f"n{(i * 5 + 1) % 24}", "CALLS", 0.9) for i in range(24)] + [(f"n{i}", "n5", "CALLS", 0.9) for i in range(6, 20)] + [("n5", "n5", "CALLS", 0.9), ("n1", "n2", "CONTAINS", 1.0)]
    findings = [(f"f{i}", f"n{i % 24}", ["low", "medium", "high"][i % 3]) for i in range(60)]
    incidents = [(f"i{i:02d}", None if i % 7 == 0 else f"2024-01-{i:02d}") for i in range(1, 29)]
    affects = [(f"i{i:02d}", f"n{i % 9}") for i in range(1, 29)]
    vectors = [(f"n{i}", [math.cos(i / 5), math.sin(i / 5)]) for i in range(24)] + [("t2", [math.cos(0.61), math.sin(0.61)])]
    d = lambda rows, s: spark.createDataFrame(rows, s)
    tables = (d(nodes, NODES), d(edges, "source string, target string, type string, confidence double"), d(findings, "id string, node_id string, severity string"), d(affects, "source string, target string"), d(incidents, "id string, observed_at string"))
    vec = d(vectors, "id string, embedding array<float>")
    return tables, vec, VectorIndex.build(vec, str(tmp_path_factory.mktemp("reports") / "v"), 3, 1)


JAVA = "x.BadException: no\n\tat a.b.F1.run(F1.java:{})\n\tat a.b.F2.run(F2.java:3)"
REPORTS = [
    (1, "why", None, None, "F1.java", 12, None), (2, "why", None, JAVA.format(15), None, None, None), (3, "see F2.java:25 or so", None, None, None, None, None), (4, "why", "broken at line 7 in F3", None, None, None, None),
    (5, "slow", None, None, None, None, [math.cos(0.6), math.sin(0.6)]), (6, "nothing", None, None, None, None, None), (7, None, None, JAVA.format(2), "F0.java", None, None), (8, "see F2.java:25", "", None, "", 0, [1.0, 0.0]),
    (9, "why", None, JAVA.format(33), None, 0, None), (10, "slow", None, None, "none.java", 9, [-1.0, 0.1]), (11, "slow", None, None, None, None, [0.0, 0.0]), (12, "why", None, JAVA.format(15), None, None, None),
]


@pytest.mark.parametrize("repo", [None, "r"])
def test_reports_are_diagnosed_as_one_by_one(spark, world, repo):
    (nodes, edges, findings, affects, incidents), vec, index = world
    table = spark.createDataFrame(REPORTS, reports.REPORTS.replace("report_id", "report_id long"))
    got = {r["report_id"]: r for r in reports.diagnose_all(table, nodes, edges, findings, affects, incidents, index, repo, probes=3).collect()}
    assert len(got) == len(REPORTS)
    assert {r["level"] for r in got.values()} == {"exact", "semantic", "none"}
    for number in (1, 3, 5, 7, 8, 9, 10) if repo is None else (2, 4, 6, 11):
        _, question, error, trace, file, line, vector = REPORTS[number - 1]
        one = diagnose.context(nodes, edges, findings, affects, incidents, question, vec, vector, repo, error=error, trace=trace, file=file, line=line)
        ids = lambda df: [r["id"] for r in df.collect()]
        want = (one.evidence_level, ids(one.epicentre), ids(one.callers), ids(one.callees), ids(one.findings), ids(one.evidence), ids(one.tests))
        r = got[number]
        assert (r["level"], [r["id"]] if r["id"] else [], r["callers"], r["callees"], r["findings"], r["evidence"], r["tests"]) == want, number
    assert tuple(got[2])[1:] == tuple(got[12])[1:]
    assert reports.diagnose_all(table.limit(0), nodes, edges, findings, affects, incidents, index).count() == 0


def test_a_side_that_was_not_counted_is_not_broadcast(spark, world, monkeypatch):
    # A table of parts has few bytes and many rows; those that were thought small passed the driver.
    (nodes, edges, findings, affects, incidents), _, index = world
    made, stored = [], reports.stored

    def noted(df, name):
        made.append((name, df))
        return stored(df, name)

    for module in (reports, intervals, vector_index):
        monkeypatch.setattr(module, "stored", noted)
    for module in (intervals, traverse):
        monkeypatch.setattr(module, "settled", lambda df: df)  # as with more rows than are collected
    monkeypatch.setattr(intervals, "SEEDS", 0)
    table = spark.createDataFrame(REPORTS, reports.REPORTS.replace("report_id", "report_id long"))
    made.append(("found", reports.diagnose_all(table, nodes, edges, findings, affects, incidents, index, probes=3)))
    made.append(("lines", intervals.at_line(nodes, table.selectExpr("report_id AS probe", "concat('src/F', report_id % 4, '.java') AS file_path", "int(report_id) AS line"), 1, ["file_path"], few=0)))
    made += [(f.__name__, f(spark, "/root/testdata/sf0.001")) for f in (queries_reports.reports, queries_reports.vectors)]
    assert len(made) > 12
    assert [name for name, df in made if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()] == []
