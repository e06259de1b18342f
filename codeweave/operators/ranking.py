"""Orders, caps and first-of-group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def by_severity(findings: DataFrame, cap: int | None = None) -> DataFrame:
    found = findings.orderBy(severity_rank(F.col("severity")), "id")
    return found if cap is None else found.limit(cap)


def latest(evidence: DataFrame, n: int = 3, order: str = "observed_at", key: str = "id") -> DataFrame:
    """The n latest; rows without a time come first. Times are compared as text."""
    return evidence.orderBy(F.col(order).desc_nulls_first(), key).limit(n)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_of(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their `rank`; Spark drops the rest before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def top_results(chunks: DataFrame, limit: int) -> DataFrame:
    """The best of each path and name (repositories share them), by score, then distance, then id."""
    order = [F.desc("score"), F.asc_nulls_first("distance"), F.asc("id")]
    return first_of(chunks, ["file_path", "name"], order).orderBy(*order).limit(limit)


def first_lines(text: Column, n: int) -> Column:
    """The first n lines that are not blank among the first n."""
    return F.filter(F.slice(F.split(text, "\n", -1), 1, n), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "") != "")


def by_file(results: DataFrame) -> DataFrame:
    """(file_path, members): results of each file, files in order of their best rank."""
    grouped = results.groupBy("file_path").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("members"))
    return grouped.orderBy("first_rank")
