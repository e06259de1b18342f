"""Secret scans: fixed patterns, and strings that a Markov model finds more random than an identifier.

Everything is DataFrame expressions. Positions come from the pieces between matches: `split` gives the gaps,
`regexp_extract_all` the matches, and running sums of their lengths the spans, in code points. Sums run over blocks of `BLOCK`
matches and then over the blocks, so that a text with very many matches costs little more than their number.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples. A candidate, a run of `LEAST` or more of the alphabet's characters that no fixed pattern touches, is a secret
where the log-likelihood ratio of its character pairs is at least `PER_CHAR` a pair and `TOTAL` in all; shorter runs are no
candidates. The training sees at most `SAMPLE` documents, one row for each.

Edge cases: null and empty texts have no spans; without samples of both kinds the ratio is 0 and nothing is added;
rows that repeat a doc_id are scanned each; null doc_ids stay. All other columns pass through `scan` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Kinds in the order of ties, their patterns and least lengths of a group (fixed values).
KINDS = ["assign", "access", "hex", "markov"]
PATTERNS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
LEAST = 16
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
PER_CHAR = 0.6
TOTAL = 12.0
#: Rows of documents whose words and secrets the training may see, and random strings that are made for it.
SAMPLE = 2_000
MADE = 3_000

#: Matches of a text that one running sum goes over.
BLOCK = 128

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(rows: Column) -> Column:
    """An array in blocks."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(rows, i + 1, F.lit(BLOCK)))


def _located(rows: Column, kind: int) -> Column:
    """Spans of the matches (gap, size, keep) that are kept: a match begins `gap` after the end of the one before."""
    empty = F.array().cast(_SPAN)

    def places(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"]))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def all_of(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, places(blocks), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    return _with(rows, lambda r: _with(_blocks(r), all_of))


def spans(text: Column, pattern: str, kind: int, group: int, least: int, keep: Column | None = None) -> Column:
    """Spans of the matches whose group has the least length, ascending."""
    matches, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    long = F.transform(groups, lambda x: F.length(x) >= least)
    rows = F.arrays_zip(F.slice(F.transform(parts, lambda x: F.length(x)), F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("size"), long.alias("keep"))
    return F.when(text.rlike(pattern), _located(rows, kind)).otherwise(F.array().cast(_SPAN))


# --- Markov models --------------------------------------------------------------------------------------------------


def identifiers(words: Column) -> Column:
    """Names as code and settings have them: each three words in turn as snake_case, CamelCase, kebab-case and UPPER_CASE."""

    def name(i: Column) -> Column:
        own = F.slice(words, i, F.lit(3))
        forms = [F.lower(F.array_join(own, "_")), F.array_join(F.transform(own, lambda w: F.initcap(w)), ""), F.array_join(own, "-"), F.upper(F.array_join(own, "_"))]
        turn = (i / 3).cast("int") % 4
        return F.when(turn == 0, forms[0]).when(turn == 1, forms[1]).when(turn == 2, forms[2]).otherwise(forms[3])

    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(1), F.size(words) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, name)


def samples(docs: DataFrame, sample: int = SAMPLE, made: int = MADE) -> DataFrame:
    """Labelled strings (s, random): secrets that the fixed patterns find in a bounded sample of documents and strings
    made from digests are random; the sample's other words, and names made of them, are ordinary."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # Of rows that share a doc_id the least text, so that the bound holds.
    seen = shared.kept(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", text.alias("t")).groupBy("doc_id").agg(F.min("t").alias("t")).select("t"), "secret-sample")
    found = [seen.select(F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(g))).alias("s")).where(F.length("s") >= least) for p, g, least in PATTERNS.values()]
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    flat = F.translate(F.base64(digest), "\r\n", "")
    turns = [F.hex(digest), F.lower(F.hex(digest)), flat, F.translate(flat, "+/=", "-_"), F.upper(F.translate(flat, "+/=", ""))]
    form = turns[-1]
    for i, t in enumerate(turns[:-1]):
        form = F.when(F.col("id") % len(turns) == i, t).otherwise(form)
    own = spark.range(made).select(F.substring(form, 1, 32).alias("s"))
    clean = F.regexp_replace(F.regexp_replace("t", PATTERNS["assign"][0], " "), f"{PATTERNS['access'][0]}|{PATTERNS['hex'][0]}", " ")
    plain = seen.select(clean.alias("t")).select(F.regexp_extract_all("t", F.lit("[A-Za-z_-]{5,}"), F.lit(0)).alias("words"), F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("parts"))
    plain = plain.select(F.explode(F.concat("words", identifiers(F.col("parts")))).alias("s"))
    rows = own.withColumn("random", F.lit(1))
    for f in found:
        rows = rows.unionByName(f.withColumn("random", F.lit(1)))
    return rows.unionByName(plain.withColumn("random", F.lit(0)))


def train(labelled: DataFrame, smooth: float = 2.0) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row; the driver gets a count for each pair and label. A pair
    that a model has not seen falls back on how often it has seen the second character."""
    k = len(ALPHABET) + 1
    pair = F.transform(F.sequence(F.lit(2), F.length("s")), lambda i: F.struct(F.substring(F.col("s"), i - 1, F.lit(1)).alias("a"), F.substring(F.col("s"), i, F.lit(1)).alias("b")))
    counted = labelled.where(F.length("s") >= 2).select("random", F.explode(pair).alias("p")).groupBy("random", F.instr(F.lit(ALPHABET), F.col("p.a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b")).count().collect()
    n = {0: [[0.0] * k for _ in range(k)], 1: [[0.0] * k for _ in range(k)]}
    for r in counted:
        n[r["random"]][r["a"]][r["b"]] = float(r["count"])
    if not all(any(map(any, m)) for m in n.values()):
        return [0.0] * (k * k)
    logs = {}
    for label, m in n.items():
        seen = [sum(row[b] for row in m) + 0.5 for b in range(k)]
        whole = sum(seen)
        logs[label] = [[math.log((m[a][b] + smooth * seen[b] / whole) / (sum(m[a]) + smooth)) for b in range(k)] for a in range(k)]
    return [logs[1][a][b] - logs[0][a][b] for a in range(k) for b in range(k)]


def ratio(s: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    k = len(ALPHABET) + 1
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.slice(codes, F.lit(1), F.size(codes) - 1)
    steps = F.zip_with(first, F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(model, a * k + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


# --- scan -----------------------------------------------------------------------------------------------------------


#: Columns of results, under names that tables hardly have.
BASE, FOUND, CANDS, FLAGS = ("__secret_base", "__secret_found", "__secret_candidates", "__secret_flags")


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """docs with FOUND, all spans (start, kind, end; kind is a number of KINDS), ascending, and BASE, those of fixed patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[spans(text, p, i, g, least) for i, (p, g, least) in enumerate(PATTERNS[x] for x in KINDS[:3])])
    cands = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def secret(s: Column) -> Column:
        pairs = F.length(s) - 1
        return F.aggregate(F.array(ratio(s, table)), F.lit(False), lambda acc, r: acc | ((r >= TOTAL) & (r >= pairs * PER_CHAR)))

    flagged = F.transform(CANDS, lambda s: secret(s))
    sizes, parts = F.transform(CANDS, lambda s: F.length(s)), F.transform(F.split(text, CANDIDATE, -1), lambda x: F.length(x))
    rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(CANDS)).alias("gap"), sizes.alias("size"), F.col(FLAGS).alias("keep"))

    def untouched(block: Column) -> Column:
        """Those of a block of spans that no fixed pattern touches; only patterns' spans near the block are looked at."""
        first, last = F.try_element_at(block, F.lit(1))["start"], F.try_element_at(block, F.lit(-1))["end"]
        return _with(F.filter(BASE, lambda b: (b["start"] < last) & (b["end"] > first)), lambda near: F.filter(block, lambda x: ~F.exists(near, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))))

    free = _with(_located(rows, 3), lambda found: F.flatten(F.transform(_blocks(found), untouched)))
    more = F.when(F.exists(FLAGS, lambda x: x), free).otherwise(F.array().cast(_SPAN))
    return docs.withColumn(BASE, F.array_sort(base)).withColumn(CANDS, cands).withColumn(FLAGS, flagged).withColumn(FOUND, F.array_sort(F.concat(BASE, more))).drop(CANDS, FLAGS)


def listed(spans_: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(i: int):
    return lambda x: x["kind"] == i


def digest(docs: DataFrame, table: list[float]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of each row of docs (doc_id, text)."""
    counts = [F.size(F.filter(FOUND, _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return scan(docs.select("doc_id", "text"), table).select("doc_id", *counts[:3], F.sha2(listed(BASE).cast("binary"), 256).alias("base_sha256"), listed(FOUND).alias("spans"), counts[3])


def redacted(docs: DataFrame, table: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs, same columns, with each run of overlapping spans replaced by a mark; a null text stays null."""
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(FOUND, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    names = docs.columns
    return scan(docs, table).withColumn("text", F.when(F.size(FOUND) > 0, done).otherwise(text)).select(*names)


def fit(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    return train(samples(docs, sample))


