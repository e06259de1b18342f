"""Texts of the tools and of the command line, over a small tree."""

import json

import pytest
from pyspark.sql import functions as F

from codeweave import cli
from codeweave.operators import filters, search
from codeweave.plans import replies, retrieve
from codeweave.plans.api import CodeGraph

TILL = """package shop;

/** Takes money. */
public class Till {
    void charge(int cents) {
        log(cents);
    }

    void log(int cents) {
    }
}
"""
DESK = """package shop;

public class Desk {
    void sell() {
        charge(3);
    }
}
"""


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "shop"
    root.mkdir()
    (root / "Till.java").write_text(TILL)
    (root / "Desk.java").write_text(DESK)
    g = CodeGraph(spark, str(tmp_path_factory.mktemp("store")), counter=lambda text: len(text.split()))
    text = str(g.ask("index_repo", root=str(root), repo="shop"))
    assert text.startswith("Indexed shop: 2 files · 7 nodes · ") and text.endswith("5 embeddings")
    g.root = str(root)
    return g


def test_results_by_file(graph):
    text = graph.ask("query_codebase", symbol="charge")
    assert text.text == (
        "Repo: shop | 3 results\n\nTill.java\n  [METHOD L5] void charge(int cents) { ← 1 caller · 1 callee\n  [METHOD L9] void log(int cents) { ← 1 caller · 0 callees\n\n"
        "Desk.java\n  [METHOD L4] void sell() { ← 0 callers · 1 callee"
    )
    assert text.input_tokens == 1 and str(text).endswith(f"\n\nToken usage: input 1, output {text.output_tokens}, total {1 + text.output_tokens}.")
    assert graph.ask("query_codebase", symbol="nothing").text == replies.NOTHING_FOUND


def test_index_of_texts_scores_as_the_texts_do(graph):
    for repo in (None, "shop", "none"):
        nodes = filters.in_repo(graph.table("nodes"), repo)
        for terms in (["Charge", "cents", "missing"], ["missing"], []):
            plain = search.bm25(nodes, "id", retrieve.node_document(), terms, 3).collect()
            assert search.bm25_indexed(graph.table("postings", repo), graph.table("corpora", repo), terms, 3).collect() == plain
            assert bool(plain) == (len(terms) > 1 and repo != "none")


def test_node_texts(graph):
    assert graph.ask("get_node_context", file="Till.java", line=6, max_lines=2).text == "METHOD shop.Till.charge\nLocation: Till.java:5-7\nLanguage: java\nSource:\n    void charge(int cents) {\n        log(cents);"
    assert graph.ask("get_node_context", file="None.java", line=6).text == replies.NOT_AT_LINE
    both = graph.ask("get_nodes_context", probes=[("None.java", 1), ("Desk.java", 5)], max_lines=1).text
    assert both == "None.java:1 — not found\n\n── METHOD shop.Desk.sell  (Desk.java:4-6)\n    void sell() {"
    with pytest.raises(ValueError, match="at most 10"):
        graph.ask("get_nodes_context", probes=[("a", 1)] * 11)


def test_diagnosis_texts(spark, graph):
    text = graph.ask("diagnose_issue", question="why", file="Till.java", line=6).text
    head = "📍 Epicentre: `charge`\n   File: Till.java  Line: 5\n   void charge(int cents) {\n\nCallers (1):\n  • sell  (Desk.java:4)\n\nCallees (1):\n  • log  (Till.java:9)"
    assert text == head + "\n── AI diagnosis unavailable ──\nNo analyst is configured."
    findings = graph.table("nodes").where("name = 'charge'").select(F.lit("f1").alias("id"), F.col("id").alias("node_id"), F.lit("R1").alias("rule_id"), F.lit("high").alias("severity"), F.lit("bad sum").alias("message"), "file_path", F.lit(6).alias("line"), F.lit("x").alias("repo_name"))
    graph.add_findings(findings, "shop")
    stored = graph.ask("ingest_incident_evidence", incident={"id": "i1", "summary": "till down", "repo_name": "shop", "service": "pay"}, file="Till.java", line=6)
    assert stored.text == "Stored evidence i1 and linked it to Till.java:5 (charge)." and stored.input_tokens is None
    assert graph.ask("ingest_incident_evidence", incident={"id": "i2", "summary": "x"}).text == "Stored evidence i2. No exact code location was linked."
    known = CodeGraph(spark, graph.store.folder, analyse=lambda prompt: f"asked with {prompt.splitlines()[0]}")
    text = known.ask("diagnose_issue", question="why", trace="java.lang.IllegalStateException: x\n\tat shop.Till.charge(Till.java:6)").text
    assert text == head + "\n\nDeterministic findings (1):\n  • R1 (Till.java:6) — bad sum\n\nLinked incident evidence (1):\n  • i1 (time unknown) — till down\n" + "─" * 60 + "\nasked with ## Question"

    def broken(prompt):
        raise RuntimeError("no key")

    known.analyse = broken
    assert known.ask("diagnose_issue", question="why", file="Till.java", line=6).text.endswith("── AI diagnosis unavailable ──\nAI analysis failed: no key")
    gap = graph.ask("diagnose_issue", question="why", file="Nowhere.java", line=1).text
    assert "\n── What is missing ──\nWithout a place in the code no cause is named.\n" in gap


def test_evaluation_texts(graph):
    one = {"id": "e1", "repo_name": "shop", "made_causal_claim": True, "resolved_correctly": False, "expected_cause_identified": True, "supported_by_evidence": True, "latency_ms": 10.0, "cost_usd": 0.5}
    assert graph.ask("record_evaluation", evaluation=one).text == "Recorded evaluation e1."
    graph.ask("record_evaluation", evaluation={**one, "resolved_correctly": True})
    assert json.loads(graph.ask("get_evaluation_metrics").text) == {"total": 1, "precision": 1.0, "recall": 1.0, "unsupported_claim_rate": 0.0, "avg_latency_ms": 10.0, "avg_cost_usd": 0.5}


def test_statistics_and_command_line(spark, graph, tmp_path, capsys):
    edges = graph.edge_total().first()["edges"]
    types = ["METHOD       3", "CLASS        2", "FILE         2"]
    want = [f"Code graph  (db: {graph.store.folder})", f"Total nodes: 7   Total edges: {edges}", "", "Indexed repos:", "  shop", f"    Path: {graph.root}", "    Nodes: 7", *[f"    {t}" for t in types]]
    assert graph.ask("get_stats").text.split("\n") == want
    empty = CodeGraph(spark, str(tmp_path / "none"))
    assert empty.ask("get_stats").text == replies.NOTHING_INDEXED
    said: list[str] = []

    def call(*argv, store=str(tmp_path / "cli")):
        args = cli.parser().parse_args(["--store", store, *argv])
        said.clear()
        cli.run(CodeGraph(spark, store), args, said.append)
        return said

    assert call("stats") == [f"Code graph (db: {tmp_path / 'cli'})\nTotal nodes: 0   Total edges: 0\n\nNo repos indexed yet."]
    out = call("index", graph.root, "--ext", "java", "--level", "med")
    assert out[0] == f"Indexing {graph.root} [level=med] …" and out[1].startswith("✓  2 files · 4 nodes · 7 edges (") and out[2] == "✓  2 embeddings stored"
    assert call("stats")[0].split("\n")[3:5] == [f"  shop  ({graph.root})", "    Nodes: 4"]
    assert call("query", "--question", "nothing here at all") == ["No results found."]
    out = call("index", graph.root)
    assert out[2] == "✓  5 embeddings stored"
    shown = call("query", "--question", "where is Till charge", "--limit", "1")[0].split("\n")
    assert shown[1] == cli.RULE and shown[2].startswith("METHOD  charge  (score: ") and shown[3:] == ["File: Till.java  L5", "    void charge(int cents) {", "        log(cents);"]
    assert call("reset-index") == ["✓ Done. Now index again."]
    assert CodeGraph(spark, str(tmp_path / "cli")).table("embeddings").count() == 0
    with pytest.raises(ValueError, match="no such tool"):
        graph.ask("nothing")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["query"])
    assert "required" in capsys.readouterr().err


def test_tokens_by_a_vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    count = replies.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count("") == 0 and count("a b") == 2
    assert replies.reply("a b", '{"x":1}', count).output_tokens == 2 and str(replies.Reply("x")) == "x"
    assert replies.request_json(a=1, b=None, c="é") == '{"a":1,"c":"é"}'
