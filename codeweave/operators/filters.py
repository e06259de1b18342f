"""Projections, point lookups and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema


def project(nodes: DataFrame) -> DataFrame:
    """A node's columns for readers, with the storage defaults: missing text is '', a missing qualified name the name."""
    return nodes.select(*[_default(c) if c in nodes.columns else F.lit("").alias(c) for c in schema.PROJECTION])


def _default(c: str) -> Column:
    if c in ("start_line", "end_line"):
        return F.col(c)
    return F.coalesce(c, "name" if c == "qualified_name" else F.lit("")).alias(c)


def in_repo(df: DataFrame, repo: str | None) -> DataFrame:
    """The rows of a repository; all where none is named."""
    return df if repo is None else df.where(F.col("repo_name") == repo)


def by_name(nodes: DataFrame, name: str, repo: str | None = None) -> DataFrame:
    return in_repo(nodes.where(F.col("name") == name), repo)


def in_file(nodes: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    return in_repo(nodes.where(F.col("file_path") == path), repo)


def by_type(nodes: DataFrame, kind: str, repo: str | None = None) -> DataFrame:
    return in_repo(nodes.where(F.col("type") == kind), repo)


def path_contains(nodes: DataFrame, hint: str) -> DataFrame:
    return nodes.where(F.col("file_path").contains(hint))


def level_nodes(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.where(F.col("type").isin(schema.LEVEL_NODES[level]))


def level_edges(edges: DataFrame, level: str) -> DataFrame:
    kinds = schema.LEVEL_EDGES[level]
    return edges.where(F.col("type").isin(kinds) if kinds else F.lit(False))


def level_embeds(nodes: DataFrame, level: str) -> DataFrame:
    kinds = schema.LEVEL_EMBEDS[level]
    return nodes.where(F.col("type").isin(kinds) if kinds else F.lit(False))


def confident(edges: DataFrame, least: float = 0.5) -> DataFrame:
    return edges.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= least)


def results(nodes: DataFrame, node_type: str | None = None) -> DataFrame:
    """Nodes with logic; a node_type that has none leaves nothing."""
    found = nodes.where(F.col("type").isin(schema.RESULT_TYPES))
    return found if node_type is None else found.where(F.col("type") == node_type)


def is_test_path(path: Column) -> Column:
    return path.rlike("(?i)test")


def is_test_source(path: Column) -> Column:
    return path.rlike(r"(?i)src[/\\]test")
