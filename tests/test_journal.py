"""Tables that grow by rows: appends, the last row of a key, links to nodes that were indexed anew, compaction."""

import os

from pyspark.sql import functions as F

from codeweave import schema
from codeweave.plans.api import CodeGraph
from codeweave.sources.journal import Journal

COLUMNS = "id string, n int, tags array<string>"


def files(folder):
    return {os.path.join(at, n) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_the_last_row_of_a_key_counts(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    assert j.last("t", COLUMNS, ["id"]).collect() == [] and j.last("t", COLUMNS, ["id"]).columns == ["id", "n", "tags"]
    j.append("t", spark.createDataFrame([("a", 9, ["x"]), ("b", 1, None), (None, 4, None)], COLUMNS))
    before = files(tmp_path)
    j.append("t", spark.createDataFrame([("a", 2, None)], COLUMNS))
    j.append("t", spark.createDataFrame([], COLUMNS))
    assert before <= files(tmp_path)  # nothing is rewritten
    want = {("a", 2, None), ("b", 1, None), (None, 4, None)}
    assert {tuple(r) for r in j.last("t", COLUMNS, ["id"]).collect()} == want
    # What a writer left half-done is not read.
    half = tmp_path / "j" / "t" / "9-x" / "_temporary" / "0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"no Parquet")
    assert {tuple(r) for r in j.last("t", COLUMNS, ["id"]).collect()} == want


def test_compaction_keeps_results_and_what_is_appended_later(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    j.compact("t", COLUMNS, ["id"])  # nothing there
    for n in range(4):
        j.append("t", spark.createDataFrame([("a", n, [str(n)]), (f"own{n}", n, None)], COLUMNS))
    want = {tuple(map(str, r)) for r in j.last("t", COLUMNS, ["id"]).collect()}
    copies = j.rows("t", COLUMNS).where("n = 0").drop("ordinal").collect()
    j.compact("t", COLUMNS, ["id"])
    assert {tuple(map(str, r)) for r in j.last("t", COLUMNS, ["id"]).collect()} == want and len(want) == 5
    assert j.rows("t", COLUMNS).count() == 5
    j.append("t", spark.createDataFrame(copies, COLUMNS))  # older in values, later in time
    assert j.last("t", COLUMNS, ["id"]).where("id = 'a'").first()["n"] == 0


def test_a_write_leaves_the_fields_that_it_lacks(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    for row in (("a", 1, ["x"]), ("a", None, ["y"]), ("a", 3, None), ("b", None, None)):
        j.append("t", spark.createDataFrame([row], COLUMNS))
    for _ in range(2):
        assert {tuple(map(str, r)) for r in j.last("t", COLUMNS, ["id"], True).collect()} == {("a", "3", "['y']"), ("b", "None", "None")}
        j.compact("t", COLUMNS, ["id"], True)
    j.append("t", spark.createDataFrame([("a", 0, None)], COLUMNS))
    assert tuple(j.last("t", COLUMNS, ["id"], True).where("id = 'a'").first()) == ("a", 0, ["y"])


def incidents(spark, rows):
    names = [c.split()[0] for c in schema.INCIDENTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.INCIDENTS)


def test_an_incident_costs_an_incident(spark, tmp_path):
    for repo in ("one", "two"):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / f"{repo}.ts").write_text(f"function run{repo}() {{ }}")
    graph = CodeGraph(spark, str(tmp_path / "store"))
    assert graph.table("links").count() == 0 and graph.table("incidents").columns[0] == "id"
    for repo in ("one", "two"):
        graph.index_repo(str(tmp_path / repo), repo)
    at = {r["repo_name"]: r["id"] for r in graph.table("nodes").where("type = 'FUNCTION'").collect()}
    rows = [{"id": f"i{n}", "summary": "down", "repo_name": "one", "service": "pay", "version": str(n), "deployment_id": "d", "linked_ids": [at["one"], at["two"], "gone"]} for n in range(3)]
    graph.add_incidents(incidents(spark, rows))
    before = files(tmp_path / "store")
    graph.ingest_incident_evidence({"id": "i1", "summary": "up again", "repo_name": "one"}, "two.ts", 1)
    assert before <= files(tmp_path / "store")
    assert {(r["id"], r["summary"]) for r in graph.table("incidents").collect()} == {("i0", "down"), ("i1", "up again"), ("i2", "down")}
    assert graph.table("incidents").where("id = 'i1'").first()["service"] == "pay"
    assert {(r["id"], r["name"]) for r in graph.table("entities").where("label = 'Service'").collect()} == {("one::service::pay", "pay")}
    affects = graph.table("links").where("type = 'AFFECTS'")
    assert {(r["source"], r["target"]) for r in affects.collect()} == {(f"i{n}", a) for n in range(3) for a in at.values()}
    others = graph.table("links").where("type <> 'AFFECTS'").count()
    graph.index_repo(str(tmp_path / "one"), "one")
    # Links to nodes of the old state are gone, those to entities and other repositories stay.
    for _ in range(2):
        assert {r["target"] for r in graph.table("links").where("type = 'AFFECTS'").collect()} == {at["two"]}
        assert graph.table("links").where("type <> 'AFFECTS'").count() == others == 6
        graph.compact()
    graph.add_incidents(incidents(spark, [{"id": "i9", "summary": "s", "linked_ids": [at["one"]]}]))
    assert graph.table("links").where(F.col("target") == at["one"]).count() == 1
