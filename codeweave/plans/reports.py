"""Diagnosis of a table of reports as one plan: what `diagnose.context` tells of one report, for all of them.

The place of a report is the one it gives, else its trace's first own frame, else the first hint in its text, else, by its
vector, the nearest code: ranked fallbacks, each a join over the reports that need it. What surrounds a place is found
once for all reports that meet there, and every list is cut to its length by rank before it is gathered. Reports and nodes both grow, and
their files tell little of their rows: they are merged, as a side that was thought small would pass the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from ..operators import filters, intervals, ranking, traverse
from ..operators.vector_index import VectorIndex, pool
from ..sources.places import stored
from . import diagnose

#: Columns of a report; all but the first may be null.
REPORTS = "report_id, question string, error string, trace string, file string, line int, vector array<double>"


def _missing(line: Column) -> Column:
    return F.coalesce(line, F.lit(0)) == 0


def _given(text: Column, other: Column) -> Column:
    """A text, or the other where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def places(reports: DataFrame) -> DataFrame:
    """reports with the file and line to look at, as `diagnose.place` has them."""
    asked = reports.where(_missing(F.col("line")) & (F.coalesce("trace", F.lit("")) != "")).select(F.col("report_id").alias("trace_id"), F.col("trace").alias("text"))
    framed = traces.epicentres(traces.frames(asked)).select(F.col("trace_id").alias("report_id"), F.col("file_path").alias("_file"), F.col("line").alias("_line"))
    one = reports.join(framed.hint("merge"), "report_id", "left").withColumns({"file": _given(F.col("file"), F.col("_file")), "line": F.coalesce("line", "_line")})
    text = F.coalesce("error", "question", F.lit(""))
    hint = F.when(_missing(F.col("line")) & (text != ""), F.get(traces.line_hints(text), F.lit(0)))
    two = one.withColumn("_hint", hint)
    return two.withColumns({"file": _given(F.col("file"), F.col("_hint.file_hint")), "line": F.coalesce("line", "_hint.line")}).drop("_file", "_line", "_hint")


def epicentres(reports: DataFrame, nodes: DataFrame, vectors: VectorIndex | None = None, repo: str | None = None, probes: int | None = None) -> DataFrame:
    """(report_id, level, id): the node of each report, `exact` by its place or `semantic` by its vector; level `none` and a null id for the rest."""
    own, at = filters.in_repo(nodes, repo), stored(places(reports).select("report_id", "file", "line"), "places")
    asked = at.where(F.col("line").isNotNull() & (F.coalesce("file", F.lit("")) != "")).select(F.col("report_id").alias("probe"), F.col("file").alias("file_hint"), "line")
    found = stored(intervals.at_line(own, asked, 1).select(F.col("probe").alias("report_id"), F.lit("exact").alias("level"), "id"), "exact")
    if vectors is not None:
        left = reports.where((F.coalesce("question", F.lit("")) != "") & F.col("vector").isNotNull()).join(found.hint("merge"), "report_id", "left_anti")
        near = vectors.nearest(left.select(F.col("report_id").alias("query_id"), "vector"), pool(diagnose.SEMANTIC, repo is not None), probes=probes)
        code = filters.results(own).where(~filters.is_test_source(F.col("file_path"))).select("id")
        best = ranking.top_of(near.join(code.hint("merge"), "id"), ["query_id"], [F.asc("rank")], 1)
        found = found.unionByName(best.select(F.col("query_id").alias("report_id"), F.lit("semantic").alias("level"), "id"))
    return reports.select("report_id").join(found.hint("merge"), "report_id", "left").withColumn("level", F.coalesce("level", F.lit("none")))


def diagnose_all(reports: DataFrame, nodes: DataFrame, edges: traverse.Edges, findings: DataFrame, affects: DataFrame, incidents: DataFrame, vectors: VectorIndex | None = None, repo: str | None = None, probes: int | None = None) -> DataFrame:
    """(report_id, level, id, callers, callees, findings, evidence, tests) of each report (`REPORTS`); the last five are arrays of ids in
    their order, as long as in `diagnose.context`, and empty where nothing is known."""
    met = stored(epicentres(reports, nodes, vectors, repo, probes), "epicentres")
    at = met.where("id IS NOT NULL").select(F.col("id").alias("origin")).distinct()
    calls = edges.where("type = 'CALLS'")
    known = nodes.select("id").hint("merge")
    order = [F.asc("distance"), F.asc("id")]
    callers, callees = (stored(traverse.walk_each(calls, at, 2, inbound).join(known, "id"), "walked") for inbound in (True, False))
    around = at.select("origin", F.col("origin").alias("node_id")).unionAll(callees.select("origin", F.col("id").alias("node_id"))).distinct()
    found = around.join(findings.select("node_id", "id", "severity").hint("merge"), "node_id")
    linked = affects.select(F.col("target").alias("origin"), F.col("source").alias("id")).distinct().join(at.hint("merge"), "origin", "left_semi").join(incidents.select("id", "observed_at").hint("merge"), "id")
    lists = {
        "callers": ranking.top_of(callers, ["origin"], order, diagnose.NEIGHBOURS),
        "callees": ranking.top_of(callees, ["origin"], order, diagnose.NEIGHBOURS),
        "findings": ranking.top_of(found, ["origin"], [ranking.severity_rank(F.col("severity")), F.asc("id")], diagnose.FINDINGS),
        "evidence": ranking.top_of(linked, ["origin"], [F.col("observed_at").desc_nulls_first(), F.asc("id")], diagnose.EVIDENCE),
        "tests": _tests(nodes, at, repo),
    }
    out = met
    for name, rows in lists.items():
        rows = stored(rows.select("origin", "rank", "id"), name)
        gathered = rows.groupBy(F.col("origin").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("of")))), lambda x: x["of"]).alias(name))
        out = out.join(gathered.hint("merge"), "id", "left")
    none = F.array().cast("array<string>")
    exact = ("findings", "evidence")
    return out.select("report_id", "level", "id", *[F.coalesce(F.when(F.col("level") == "exact", F.col(c)) if c in exact else F.col(c), none).alias(c) for c in lists])


def _tests(nodes: DataFrame, at: DataFrame, repo: str | None) -> DataFrame:
    """(origin, id, rank): tests named after a node, or else its first namesakes in test files."""
    own = filters.in_repo(filters.results(nodes), repo).where(filters.is_test_path(F.col("file_path"))).select("id", "name").hint("merge")
    names = nodes.join(at.hint("merge"), F.col("id") == F.col("origin")).select("origin", F.col("name").alias("_name"))
    after = names.withColumn("name", F.concat("_name", F.lit("Test"))).join(own, "name").select("origin", "id")
    same = ranking.top_of(names.withColumn("name", F.col("_name")).join(own, "name"), ["origin"], [F.asc("id")], diagnose.SAME_NAME_TESTS)
    rest = same.join(after.select("origin").distinct().hint("merge"), "origin", "left_anti").select("origin", "id")
    return ranking.top_of(after.unionByName(rest), ["origin"], [F.asc("id")], diagnose.TESTS)
