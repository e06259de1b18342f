"""What is known about a reported failure: the code where it broke, what leads there and what it calls, and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from ..operators import filters, intervals, ranking, traverse, vector_index

#: Caps of the context and of the prompt (fixed values).
FINDINGS, EVIDENCE, NEIGHBOURS, TESTS = 5, 3, 3, 2
SAME_NAME_TESTS, SEMANTIC = 3, 5
EPICENTRE_LINES, TRACE_LINES = 15, 8


@dataclass
class Context:
    evidence_level: str
    epicentre: DataFrame
    callers: DataFrame
    callees: DataFrame
    findings: DataFrame
    evidence: DataFrame
    tests: DataFrame


def place(spark, question: str | None, error: str | None = None, trace: str | None = None, file: str | None = None, line: int | None = None) -> tuple[str | None, int | None]:
    """The file and line to look at: those given, else the trace's first own frame, else the first hint in the text."""
    if not line and trace:
        found = traces.epicentres(traces.frames(spark.createDataFrame([(0, trace)], "trace_id int, text string"))).first()
        if found:
            file, line = file or found["file_path"], line if line is not None else found["line"]
    if not line and (text := error if error is not None else question):
        hints = spark.range(1).select(traces.line_hints(F.lit(text)).alias("h")).first()["h"]
        if hints:
            file, line = file or hints[0]["file_hint"], line if line is not None else hints[0]["line"]
    return file, line


def context(nodes: DataFrame, edges: DataFrame, findings: DataFrame, affects: DataFrame, incidents: DataFrame, question: str, embeddings: DataFrame | vector_index.VectorIndex | None = None, vector: list[float] | None = None, repo: str | None = None, **where) -> Context:
    """The context of a report; `where` as for `place`. An exact place need not enclose the line: the nearest node above serves."""
    spark = nodes.sparkSession
    file, line = place(spark, question, **where)
    level, best = "none", None
    if line is not None and file:
        probe = spark.createDataFrame([(0, file, line)], "probe int, file_hint string, line int")
        best = intervals.at_line(filters.in_repo(nodes, repo), probe, 1).select("id").first()
        level = "exact" if best else "none"
    if best is None and question and embeddings is not None and vector is not None:
        hits = vector_index.scoped_search(embeddings, vector, SEMANTIC, filters.in_repo(nodes, repo) if repo else None)
        own = filters.results(nodes).where(~filters.is_test_source(F.col("file_path")))
        best = hits.join(own, "id").orderBy(F.desc("score"), "id").select("id").first()
        level = "semantic" if best else "none"
    key = best["id"] if best else ""
    epicentre = nodes.where(F.col("id") == key)
    order = [F.col("distance"), F.col("id")]
    callers = traverse.callers(nodes, edges, key, 2).orderBy(*order)
    callees = traverse.callees(nodes, edges, key, 2)
    exact = F.lit(level == "exact")
    at = epicentre.select(F.col("id").alias("node_id")).unionAll(callees.select("id"))
    known = ranking.by_severity(findings.where(exact).join(at.distinct(), "node_id", "left_semi"), FINDINGS)
    linked = affects.where((F.col("target") == key) & exact).select(F.col("source").alias("id"))
    return Context(level, epicentre, callers.limit(NEIGHBOURS), callees.orderBy(*order).limit(NEIGHBOURS), known, ranking.latest(incidents.join(linked, "id", "left_semi"), EVIDENCE), tests(nodes, epicentre, repo))


def tests(nodes: DataFrame, epicentre: DataFrame, repo: str | None = None) -> DataFrame:
    """Tests of a node: those named after it, or else its namesakes in test files."""
    own = filters.in_repo(filters.results(nodes), repo).where(filters.is_test_path(F.col("file_path")))
    names = epicentre.select(F.col("name").alias("_name"))
    after = own.join(F.broadcast(names), F.col("name") == F.concat("_name", F.lit("Test"))).withColumn("_turn", F.lit(0))
    same = own.join(F.broadcast(names), F.col("name") == F.col("_name")).orderBy("id").limit(SAME_NAME_TESTS).withColumn("_turn", F.lit(1))
    both = after.unionAll(same)
    first = both.agg(F.min("_turn").alias("_first"))
    return both.join(F.broadcast(first), F.col("_turn") == F.col("_first")).orderBy("id").limit(TESTS).drop("_name", "_turn", "_first")


def prompt(ctx: Context, question: str, error: str | None = None, trace: str | None = None, runtime: str | None = None) -> str:
    """The sections of a report, in order; what is not known has none."""
    parts = [f"## Question\n{question}"]
    if error:
        parts.append(f"## Error\n{error}")
    if trace:
        parts.append("## Stack trace\n" + "\n".join(trace.split("\n")[:TRACE_LINES]))
    if runtime:
        parts.append(f"## Runtime evidence\n{runtime}")
    for r in ctx.epicentre.collect():
        body = "\n".join((r["source_code"] or "").split("\n")[:EPICENTRE_LINES])
        parts.append(f"## Epicentre ({ctx.evidence_level})\n{r['type']} {r['name']} {r['file_path']}:{r['start_line']}-{r['end_line']}\n{body}")
    for title, df, text in (
        ("Static findings", ctx.findings, lambda r: f"[{r['severity']}] {r['rule_id']}: {r['message']}"),
        ("Incidents", ctx.evidence, lambda r: f"{r['observed_at'] or '?'} {r['summary']}"),
        ("Callers", ctx.callers, lambda r: f"{r['name']} {r['file_path']}:{r['start_line']}"),
        ("Callees", ctx.callees, lambda r: f"{r['name']} {r['file_path']}:{r['start_line']}"),
        ("Related tests", ctx.tests, lambda r: f"{r['name']} {r['file_path']}"),
    ):
        rows = df.collect()  # capped above
        if rows:
            parts.append(f"## {title}\n" + "\n".join(map(text, rows)))
    return "\n\n".join(parts)


def summary(ctx: Context, question: str, analyse=None, **parts) -> str:
    """The report; an analyst, if one is given, is asked only where the evidence is exact."""
    text = prompt(ctx, question, **parts)
    if ctx.evidence_level != "exact":
        return f"{text}\n\n## Evidence gap\nNo exact place in the code; no cause is claimed."
    return f"{text}\n\n## Diagnosis\n{analyse(text)}" if analyse else text
