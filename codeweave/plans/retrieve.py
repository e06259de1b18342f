"""Hybrid retrieval as one plan: exact hits, else vector and full-text hits, call-graph expansion, fusion, top results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fields, filters, fusion, ranking, search, traverse, vector_index

SEMANTIC_SEEDS = LEXICAL_SEEDS = 3
SOURCE_LINES = 2


def node_document() -> Column:
    """What full-text search reads of a node."""
    return F.concat_ws(" ", "name", "qualified_name", "file_path", "first_line", "source_code")


def seeds(nodes: DataFrame, embeddings: DataFrame | vector_index.VectorIndex | None, question: str | None = None, symbol: str | None = None, file_path: str | None = None, repo: str | None = None, vector: list[float] | None = None, index: tuple[DataFrame, DataFrame] | fields.FieldIndex | None = None, everything: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """exact (id), semantic (id, score) and lexical (id, score) seeds. The latter two are empty where there is an exact one.
    `embeddings` may be a vector index; a search within one repository takes no more than its pool of candidates.
    `index` is the full-text index of the same nodes (postings, corpora), or one over the fields of `everything`, the nodes of all repositories;
    without it the text is read."""
    spark = nodes.sparkSession
    exact = spark.createDataFrame([], "id string")
    if symbol:
        exact = exact.unionAll(filters.by_name(nodes, symbol, repo).select("id"))
    if file_path:
        exact = exact.unionAll(filters.in_file(nodes, file_path, repo).select("id"))
    exact = traverse.settled(exact.distinct())
    none = spark.createDataFrame([], "id string, score double")
    if not question or ((symbol or file_path) and not exact.isEmpty()):
        return exact, none, none
    own = filters.in_repo(nodes, repo)
    semantic = none
    if embeddings is not None and vector is not None:
        semantic = traverse.settled(vector_index.scoped_search(embeddings, vector, SEMANTIC_SEEDS, own if repo else None))
    terms = spark.range(1).select(search.query_terms(F.lit(question)).alias("t")).first()["t"]
    if not terms:
        return exact, semantic, none
    if isinstance(index, fields.FieldIndex):
        found = fields.scoped_search(index, nodes if everything is None else everything, terms, LEXICAL_SEEDS, own if repo else None)
    else:
        found = search.bm25_indexed(*index, terms, LEXICAL_SEEDS) if index else search.bm25(own, "id", node_document(), terms, LEXICAL_SEEDS)
    hits = traverse.settled(found)
    order = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1  # three rows
    return exact, semantic, hits.withColumn("score", fusion.lexical_score(order))


def retrieve(nodes: DataFrame, edges: DataFrame, exact: DataFrame, semantic: DataFrame, lexical: DataFrame, depth: int = 1, limit: int = 4, repo: str | None = None, node_type: str | None = None) -> DataFrame:
    """(id, type, name, file_path, score, distance, callers, callees), best first, from seeds; methods and functions that have source alone."""
    start = exact.select("id").unionAll(semantic.select("id")).unionAll(lexical.select("id"))
    calls = fusion.call_scores(traverse.calls_graph(nodes, edges, start, depth, repo))
    fused = fusion.fuse(exact, semantic, lexical, calls)
    found = filters.results(nodes, node_type).join(fused, "id")
    if "first_line" in nodes.columns:  # what lenses without source do not have
        lines = ranking.first_lines(F.coalesce("source_code", "first_line", F.lit("")), SOURCE_LINES)
        found = found.withColumn("source_lines", lines).where((F.size("source_lines") > 0) | (F.coalesce("first_line", F.lit("")) != ""))
    top = traverse.settled(ranking.top_results(found, limit))
    return top.join(traverse.call_counts(nodes, edges, top), "id")
