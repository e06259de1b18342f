"""Scalar functions, scans, traces, embeddings and the store."""

import pytest
from pyspark.sql import functions as F

from codeweave.functions import embed, text, traces
from codeweave.plans.api import CodeGraph
from codeweave.sources import scan


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_node_text(spark):
    body = 'AdapterConstants.LIMIT; getConfigurationItem( MODE ); "please read this" "https://no.example/x" "ALL_CAPS_NAME" a.getTarget() b.getUserName()'
    got = one(spark, text.node_text(F.lit("METHOD"), F.lit("run"), F.col("p"), F.lit(" int run() "), F.col("b")), p="x\\svc\\Run.java", b=body)
    assert got == "METHOD run in svc/Run: int run() config:LIMIT MODE please read this Tar UserName"
    assert one(spark, text.node_text(F.lit("CLASS"), F.lit("A"), F.col("p"), F.lit(""), F.lit("")), p="x/A.java") == "CLASS A in x/A.java"


def test_paths_and_lines(spark):
    for path, ext in (("a/b.tar.gz", ".gz"), ("a/.env", ""), ("x", ""), ("a.b/c", ""), ("A.Java", ".Java")):
        assert one(spark, text.extension(F.col("p")), p=path) == ext
    assert one(spark, text.span_source(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, text.first_line(F.col("t"), F.lit(9)), t="a") == ""
    assert one(spark, text.should_embed(F.lit("CLASS"), F.col("p")), p="src/DTO/A.java") is False
    assert text.extensions_option("ts, .js,") == [".ts", ".js"]


def test_scan_filter(spark):
    keep = {"src/App.TS": True, "src/test/a.ts": False, "a.test.ts": False, "b-test.JS": False, "Dockerfile": True, "x/notes.txt": False, "dist/a.js": False, "a/R.R": True, "c.java": True}
    df = spark.createDataFrame([(p,) for p in keep], "p string")
    assert {r["p"]: r["k"] for r in df.select("p", scan.is_scanned(F.col("p")).alias("k")).collect()} == keep
    assert one(spark, scan.is_scanned(F.col("p"), [".Java"]), p="A.Java") is False
    assert one(spark, scan.is_scanned(F.col("p"), None, ["gen"]), p="gen/A.java") is False


def test_repositories_and_env():
    for url in ("acme/shop", "https://github.com/acme/shop.git", "github.com/acme/shop/"):
        assert scan.parse_repository(url) == ("https://github.com/acme/shop.git", "shop")
    assert scan.parse_repository("git@host.example:acme/shop.git")[1] == "shop"
    with pytest.raises(ValueError):
        scan.parse_repository("")
    assert scan.clone_command("acme/shop", "/x", False)[:4] == ["git", "clone", "--depth", "1"] and "pull" in scan.clone_command("acme/shop", "/x", True)
    assert scan.read_env("A=1\n# no\nB='2'\nbad", {"A": "0"}) == {"A": "0", "B": "2"}


def test_traces(spark):
    rows = [
        (1, "java.lang.IllegalStateException: x\n\tat com.a.B$C.<init>(B.java:3)\r\n\tat com.a.D.run(D.kt:4)\n\tat com.a.E.f(Native Method)"),
        (2, "Error: no\n    at Object.<anonymous> (/a/b.js:1:2)\n    at A.b.c (x.ts:5:1)\n    at node:internal/x.js:7:1"),
        (3, "main.f(0x1)\nunrelated\n\t/a.go:3 +0x1\n\t/b.go:4\nmain.g()\n  File \"z.py\", line 2, in h\n\t/c.go:9"),
        (4, ""),
    ]
    df = spark.createDataFrame(rows, "trace_id int, text string")
    got = {}
    for r in traces.frames(df).orderBy("trace_id", "pos").collect():
        got.setdefault(r["trace_id"], []).append((r["lang"], r["class_name"], r["method_name"], r["file_path"], r["line"]))
    assert got == {
        1: [("java", "B$C", "<init>", "B.java", 3), ("java", "D", "run", "D.kt", 4)],
        2: [("node", "Object", None, "/a/b.js", 1), ("node", "b", "c", "x.ts", 5), ("node", None, None, "node:internal/x.js", 7)],
        3: [("go", None, "f", "/a.go", 3), ("python", None, "h", "z.py", 2)],
    }
    assert {r["trace_id"]: r["error_message"] for r in traces.errors(df).collect()} == {1: "java.lang.IllegalStateException: x", 2: "Error: no"}
    strict = spark.createDataFrame([(1, "\tat java.util.List.get(List.java:1)\n\tat a.B.c(B.java:2)")], "trace_id int, text string")
    assert [traces.epicentres(traces.frames(strict), s).first()["file_path"] for s in (False, True)] == ["List.java", "B.java"]


def test_embedders():
    e = embed.HashingEmbedder(64)
    a, b, c = e.embed(["getUserName of account", "account user name", "zebra"])
    assert abs(float(a @ a) - 1) < 1e-5 and a @ b > a @ c and not e.embed([""]).any()
    with pytest.raises(ValueError):
        embed.HostedEmbedder()
    hosted = embed.HostedEmbedder(lambda texts: [(1, [1.0]), (0, [0.0])], 1)
    assert hosted.embed(["a", "b"]).tolist() == [[0.0], [1.0]]


def test_code_graph_from_files(spark, tmp_path):
    src = tmp_path / "src" / "app"
    src.mkdir(parents=True)
    (src / "Shop.java").write_text("package a;\npublic class Shop extends Base {\n  public int sell(String id) {\n    return price(id) + tax();\n  }\n  int price(String id) { return 1; }\n}\n")
    (src / "Base.java").write_text("package a;\nclass Base {\n  int tax() {\n    return 2;\n  }\n}\n")
    g = CodeGraph(spark, f"file://{tmp_path}/graph")
    assert tuple(g.index_repo(str(tmp_path / "src"), "r").first())[:4] == (2, 7, 9, 0)
    got = {(r["source"].split(":")[4], r["target"].split(":")[4]) for r in g.table("edges").where("type = 'CALLS'").collect()}
    assert got == {("sell", "price"), ("sell", "tax")}
    assert g.table("edges").where("type = 'EXTENDS'").count() == 1
    assert [r["name"] for r in g.query_codebase(symbol="sell", depth=1, limit=9).orderBy(F.desc("score"), "name").collect()] == ["sell", "price", "tax"]
    assert "sell" in {r["name"] for r in g.query_codebase(question="how do we sell by id", limit=3).collect()}
    g.ingest_incident_evidence({"id": "i", "summary": "down", "repo_name": "r", "service": "s", "observed_at": "2024"}, "Base.java", 4)
    ctx = g.diagnose_issue("why", trace="x.BadException: a\n\tat a.Base.tax(Base.java:4)")
    assert ctx.evidence_level == "exact" and ctx.epicentre.first()["name"] == "tax" and ctx.callers.first()["name"] == "sell" and ctx.evidence.count() == 1
    assert g.diagnose_issue("sell something by id").evidence_level in ("semantic", "none")
    assert g.edge_total().first()[0] == g.table("edges").count() + 2
    g.index_repo(str(tmp_path / "src"), "r", "low")
    assert g.table("nodes").count() == 2 and g.table("edges").count() == 0 and g.table("embeddings").count() == 0
    assert [r["found"] for r in g.get_nodes_context([("Base.java", 3), ("none", 1)]).collect()] == [True, False]
