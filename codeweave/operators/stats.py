"""Counts and metrics."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .filters import in_repo


def repo_stats(nodes: DataFrame) -> DataFrame:
    """(repo_name, repo_path, total, by_type): nodes of each repository, types by falling count."""
    counts = nodes.groupBy("repo_name", "type").agg(F.count("*").alias("n"), F.min("repo_path").alias("repo_path"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "type", "n"))), lambda x: F.struct(x["type"], x["n"]))
    return counts.groupBy("repo_name").agg(F.min("repo_path").alias("repo_path"), F.sum("n").alias("total"), F.map_from_entries(ordered).alias("by_type"))


def edge_total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"))


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), F.nullif(bottom, F.lit(0)).cast("double")), F.lit(0.0))


def evaluation_metrics(evaluations: DataFrame, repo: str | None = None) -> DataFrame:
    """Precision of causal claims, recall of causes, share of unsupported claims, mean latency and cost; 0 for nothing."""
    claim, right, known, backed = (F.coalesce(F.col(c), F.lit(False)) for c in ("made_causal_claim", "resolved_correctly", "expected_cause_identified", "supported_by_evidence"))
    n_claims = F.count_if(claim)
    return in_repo(evaluations, repo).agg(
        F.count("*").alias("total"),
        _ratio(F.count_if(claim & right), n_claims).alias("precision"),
        F.coalesce(F.avg(F.when(known, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall"),
        _ratio(F.count_if(claim & ~backed), n_claims).alias("unsupported_claim_rate"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("avg_cost_usd"),
    )


#: Edges that the summary of an index leaves out.
INHERITANCE = ("EXTENDS", "IMPLEMENTS", "INJECTS")


def index_summary(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """files, nodes, edges (structural ones and calls not yet resolved, no inheritance), findings (0)."""
    written = edges.where(~F.col("type").isin(*INHERITANCE))
    one = [files.agg(F.count("*").alias("files_scanned")), nodes.agg(F.count("*").alias("nodes_found")), written.agg(F.count("*").alias("edges_found"))]
    return one[0].join(one[1], how="cross").join(one[2], how="cross").withColumn("findings_found", F.lit(0).cast("long"))


class IndexCounts:
    """The same counts as `index_summary`, observed while the tables are written: no job of their own, no plan run twice.

    Pass what is written through `files`, `records` and `nodes`; `row` waits for the writes and has the milliseconds since the start, too.
    """

    def __init__(self, kinds: list[str]) -> None:
        self.kinds, self.began = [k for k in kinds if k not in INHERITANCE], time.monotonic()
        self._of: dict[str, Observation] = {}

    def _seen(self, name: str, df: DataFrame, count: Column) -> DataFrame:
        self._of[name] = Observation()
        return df.observe(self._of[name], count.alias("n"))

    def files(self, df: DataFrame) -> DataFrame:
        return self._seen("files_scanned", df, F.count(F.lit(1)))

    def records(self, df: DataFrame) -> DataFrame:
        return self._seen("edges_found", df, F.count_if((F.col("record") == "edge") & F.col("type").isin(self.kinds)))

    def nodes(self, df: DataFrame) -> DataFrame:
        return self._seen("nodes_found", df, F.count(F.lit(1)))

    def row(self, spark: SparkSession) -> DataFrame:
        """(files_scanned, nodes_found, edges_found, findings_found, duration_ms)"""
        n = {name: seen.get["n"] for name, seen in self._of.items()}
        took = int(1000 * (time.monotonic() - self.began))
        return spark.createDataFrame([(n.get("files_scanned", 0), n.get("nodes_found", 0), n.get("edges_found", 0), 0, took)], "files_scanned long, nodes_found long, edges_found long, findings_found long, duration_ms long")


def repo_label(nodes: DataFrame) -> DataFrame:
    """The one repository's name, or how many there are."""
    n = F.count_distinct("repo_name")
    return nodes.agg(F.when(n == 1, F.min("repo_name")).otherwise(F.concat(n.cast("string"), F.lit(" repos"))).alias("label"))


def llm_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage (model, <kind>_tokens...) with `cost`, by rates (model, kind, per_million); unknown models cost 0."""
    kinds = [c for c in usage.columns if c.endswith("_tokens")]
    wide = rates.groupBy("model").pivot("kind", [k.removesuffix("_tokens") for k in kinds]).agg(F.first("per_million"))
    total = F.lit(0.0)
    for k in kinds:
        total = total + F.coalesce(F.col(k), F.lit(0)) * F.coalesce(F.col(k.removesuffix("_tokens")), F.lit(0.0))
    return usage.join(F.broadcast(wide), "model", "left").withColumn("cost", total / 1e6).select(*usage.columns, "cost")
