"""A training corpus from raw documents: five stages, each by one operator of `codeweave.llm`.

1. toxicity: documents that the lexicon rejects go.
2. near_duplicates: of documents whose sets of 5-word shingles link at a Jaccard coefficient of 0.8 or more, directly or
   through others, the one with the least doc_id stays.
3. secrets: spans of secrets are replaced by a mark; no document goes.
4. mixing: sources are brought to target weights; a leaf with more budget than tokens is read several times, so a
   document may come more than once, and the last document of a pass may be cut.
5. packing: what is left is packed into windows of 2048 tokens; the result is a row for each piece.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept; all but the last return the columns of `documents`,
with `n_chars` kept in step with the text. Null texts are neither toxic nor duplicates and have no tokens, so the
mixing leaves them out; an empty table stays empty. Rows that share a doc_id are one document to the second stage: they stay or go together, and of
equal ones one stays; null doc_ids stay. Ties in the order of an epoch go by the text, and equal rows in no order that shows. Texts of any
length are read whole, in blocks; other columns of the input, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import jaccard_join, mixing, packing, queries, secrets, shared, toxicity

THRESHOLD = 0.3
WORDS, PERCENT = 5, 80
BUDGET, EPOCHS, SEED = 0.6, 4, 17
WINDOW, END_ID = 2048, 1


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as long as the text is."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.passed(docs, lexicon, THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_of(docs, WORDS, PERCENT)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redacted(docs, secrets.fit(docs)), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("document"))
    chosen = mixing.mix(rows, mixing.tree(), mixing.WEIGHTS, BUDGET, EPOCHS, SEED)
    cut = mixing.cut_text(F.col("text"), F.col("take_tokens"), F.col("n_tokens"))
    return _sized(chosen.select(*[(cut if c == "text" else F.col("document")[c]).alias(c) for c in docs.columns]), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary(), END_ID, WINDOW)


STAGES = [("toxicity", clean), ("near_duplicates", near_duplicates), ("secrets", secret_spans), ("mixing", mixed), ("packing", packed)]

#: Neither a learned lexicon nor token ids are SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
