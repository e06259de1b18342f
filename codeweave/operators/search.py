"""Vector search and full-text search."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import spread

#: Least cosine of a hit (fixed value).
SEMANTIC_THRESHOLD = 0.30
K1, B = 1.2, 0.75
TERM_PATTERN = r"[\p{L}\p{N}]+"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in doubles; null where one of them is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(embeddings: DataFrame, query: list[float], threshold: float = SEMANTIC_THRESHOLD, k: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, score) of the vectors at least as near as the threshold, best first; among `ids` alone if they are given.
    Without k there is no limit. Vectors of another length, zero ones and those whose score is no number are not found."""
    rows = embeddings if ids is None else embeddings.join(ids.select("id"), "id", "left_semi")
    vector = F.array(*[F.lit(float(x)) for x in query])
    hits = rows.select("id", cosine(F.col("embedding"), vector).alias("score")).where((F.col("score") >= threshold) & ~F.isnan("score")).orderBy(F.desc("score"), "id")
    return hits if k is None else hits.limit(k)


def query_terms(question: Column) -> Column:
    """The ten strongest terms of a question: runs of letters and digits of at least 4, once each, by length and a bonus
    of 3 for a capital at the start; ties in order of appearance."""
    terms = F.filter(F.array_distinct(F.regexp_extract_all(question, F.lit(TERM_PATTERN), F.lit(0))), lambda t: F.length(t) >= 4)
    weight = lambda t: F.length(t) + F.when(F.substring(t, 1, 1) != F.lower(F.substring(t, 1, 1)), 3).otherwise(0)
    ranked = F.array_sort(F.transform(terms, lambda t, i: F.struct((-weight(t)).alias("w"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda x: x["t"]), 1, 10)


def full_text_query(question: Column) -> Column:
    return F.array_join(query_terms(question), " OR ")


def counted(docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """(keep, len, term, tf): the terms of each row and how often it has them. A row is counted by itself, from its sorted terms: what a task holds
    does not grow with its rows, and nothing is shuffled."""
    ordered = docs.select(*keep, F.sort_array(terms).alias("_t"))
    # Where a term differs from the one before it.
    starts = F.filter(F.transform("_t", lambda x, i: F.when((i == 0) | (x != F.get("_t", i - 1)), i)), lambda i: i.isNotNull())
    runs = F.transform("_s", lambda at, j: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_s", j + 1), F.size("_t")) - at).cast("long").alias("tf")))
    return ordered.withColumn("_s", starts).select(*keep, F.size("_t").alias("len"), F.inline(runs))


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The inverted index (id, term, tf, len): terms in lower case, by document. Texts are dealt by their ids; terms are only grouped, and so shuffled,
    where an id comes twice, for which the ids are looked at first."""
    terms = F.regexp_extract_all(F.lower("_text"), F.lit(TERM_PATTERN), F.lit(0))
    found = counted(spread(docs.select(F.col(id_col).alias("id"), text.alias("_text")), "id"), terms, "id")
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return found.select("id", "term", "tf", "len")
    return found.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))


def corpus(docs: DataFrame, text: Column) -> DataFrame:
    """(docs, words): a row with the number of documents and of their terms."""
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM_PATTERN), F.lit(0)))), F.lit(0)).cast("long").alias("words"))


def bm25_indexed(index: DataFrame, corpora: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score) as `bm25` gives them, from `postings` and the `corpus` rows of the same documents: reads the
    postings of the terms alone."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    held = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term asked
    total = corpora.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()  # one row
    idf = F.lit(0.0)
    for term, df in sorted(held.items()):
        idf = F.when(F.col("term") == term, F.lit(math.log(1 + (total["n"] - df + 0.5) / (df + 0.5)))).otherwise(idf)
    mean = total["words"] / total["n"] if total["words"] else 1.0
    score = F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean))))
    return hits.groupBy("id").agg(F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def is_term(term: str) -> Callable[[Column], Column]:
    """A test of an element: a lambda with the term for a second parameter would be given the place."""
    return lambda x: x == term


def bm25(docs: DataFrame, id_col: str, text: Column, terms: list[str], k: int) -> DataFrame:
    """(id, score) of the k best documents that have any of the terms.

    Two passes over the text and no shuffle: one counts documents, lengths and, for each of the terms, the documents that have it;
    one scores each document by itself.
    """
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return docs.sparkSession.createDataFrame([], "id long, score double").limit(0)
    tokens = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)).alias("terms")).select(
        "id", F.size("terms").alias("len"), F.filter("terms", lambda t: t.isin(wanted)).alias("own")
    )
    has = [F.count_if(F.array_contains("own", t)).alias(f"df{i}") for i, t in enumerate(wanted)]
    corpus = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *has).first()  # one row
    score = F.lit(0.0)
    for i, t in enumerate(wanted):
        df = corpus[f"df{i}"]
        idf = math.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5))
        tf = F.size(F.filter("own", is_term(t)))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(corpus["avg_len"] or 1.0)))
    return tokens.where(F.size("own") > 0).select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
