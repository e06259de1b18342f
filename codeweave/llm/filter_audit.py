"""How filters of documents interact: what each of them removes, in every order in which they can be applied.

Native expressions give each document a mask of five bits, one for each filter that it fails. Documents are counted by
part and mask, 32 cells a part at most; what any order removes at any step follows from the cells alone, so the 120 orders
cost nothing that grows with the documents. Filters, by the bit of the mask from the lowest:

A few words (under `LEAST_WORDS`), B repetitive (under 65 distinct words in 100), C capitals (over 5 of A-Z in 100 code
points), D symbols (any of #$%&*|), E a copy: a document of smaller doc_id has the identical text.

The least doc_id of a text comes from a grouping by the text's SHA-256, not by the text, so texts are not shuffled. What
repeats is joined back by tables that are written first, so adaptive execution can split a popular text.

Edge cases: a null text is an empty one, a null source the empty string (and one part with it); a null doc_id is smaller than none and
larger than none, so it neither is a copy nor makes one; rows that repeat a doc_id and its text are no copies of each
other; a document is good or toxic if any row of `labels` with its doc_id says so, null labels and ids say nothing; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT, CAPITALS = 50, 65, 5
SPACES = "[\\x20\\x09-\\x0D]+"
STEPS = "array<struct<filter_order:string,step:int,earlier:int,bit:int>>"


def mask(text: F.Column) -> F.Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * DISTINCT, capitals * 100 > F.length(text) * CAPITALS, text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of docs (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("print"), mask(text).alias("own"))
    rows = shared.kept(rows, "audit-rows")
    copied = rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("print", "least")
    copied = shared.kept(copied, "audit-copied")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(copied, "print", "left").select("doc_id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell that has any, and those of them with quality = 1 and toxic = 1."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    known = shared.kept(known.where("good + toxic > 0"), "audit-labels")
    counted = masks(docs).join(known, "doc_id", "left").groupBy("part", "mask")
    return counted.agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, bit of the step's filter) of all steps of all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [("".join(order), i + 1, sum(bits[:i]), b) for i, b in enumerate(bits)]
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps([{"filter_order": o, "step": s, "earlier": e, "bit": b} for o, s, e, b in orders()])), STEPS)
    rows = by_part.select("part", "cells", F.inline(steps))
    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("earlier")) != 0

    def total(where, value=lambda c: c["n"]) -> F.Column:  # noqa: ANN001
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c), value(c)).otherwise(F.lit(0)))

    here = lambda c: fails(c) & ~gone(c)
    # Of the filters that a document fails, each is the first in as many orders as any other.
    share = lambda c: c["n"] * (F.lit(math.factorial(len(FILTERS))) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~gone(c) & ~fails(c)).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


#: By the documents of each step, not by cells.
ORACLE = f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
f AS (SELECT w.doc_id, part, [len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < {DISTINCT} * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w JOIN least USING (t) LEFT JOIN g USING (doc_id)),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, bad),
s AS (SELECT part, array_to_string(list_transform(o, lambda x: chr((64 + x)::integer)), '') AS filter_order, i.i AS step, o[i.i] AS own, n, good, toxic, bad[o[i.i]] AS fails, len(list_filter(o[1:i.i - 1], lambda x: bad[x])) > 0 AS gone, len(list_filter(bad, lambda x: x)) AS many FROM c, o, i),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::integer AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM r"""
