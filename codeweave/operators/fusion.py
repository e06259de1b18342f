"""One score from exact, semantic, lexical and call-graph evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores (fixed values).
EXACT, CALLEE, CALLER, BOOST = 1.0, 0.25, 0.20, 0.10
LEXICAL_BASE, LEXICAL_DECAY = 0.85, 0.05


def lexical_score(rank: Column) -> Column:
    """By rank from 0."""
    return F.lit(LEXICAL_BASE) - F.lit(LEXICAL_DECAY) * rank


def call_scores(graph: DataFrame) -> DataFrame:
    """(id, call, distance) from (id, direction, distance): the better of both directions, nearer counting more."""
    base = F.when(F.col("direction") == "callee", CALLEE).otherwise(CALLER)
    return graph.groupBy("id").agg(F.max(base / F.greatest(F.lit(1), "distance")).alias("call"), F.min("distance").alias("distance"))


def fuse(exact: DataFrame, semantic: DataFrame, lexical: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, score, distance) from exact (id), semantic (id, score), lexical (id, score), calls (id, call, distance)."""
    none = F.lit(None).cast("double")
    rows = exact.select("id", F.lit(1).alias("e"), none.alias("s"), none.alias("l"), none.alias("c"), F.lit(0).alias("d"))
    rows = rows.unionAll(semantic.select("id", F.lit(0), F.col("score"), none, none, F.lit(0)))
    rows = rows.unionAll(lexical.select("id", F.lit(0), none, F.col("score"), none, F.lit(0)))
    rows = rows.unionAll(calls.select("id", F.lit(0), none, none, F.col("call"), F.col("distance")))
    one = rows.groupBy("id").agg(F.max("e").alias("e"), F.max("s").alias("s"), F.max("l").alias("l"), F.max("c").alias("c"), F.min("d").alias("distance"))
    found = F.greatest(F.coalesce("s", F.lit(0.0)), F.coalesce("l", F.lit(0.0)))
    score = F.when(F.col("e") == 1, EXACT).when((found > 0) & F.col("c").isNotNull(), found + BOOST).when(found > 0, found).otherwise(F.col("c"))
    return one.select("id", score.alias("score"), "distance").where(F.col("score").isNotNull())
