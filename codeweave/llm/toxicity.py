"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lowers letters, turns look-alike letters of other scripts and full-width forms into Latin ones, digits and signs
that stand for letters into those, and drops invisible characters; `l` and `i` become one letter, as `1` stands for
both. The lexicon is learned from labelled rows: whole words, and beginnings of words, that are far more frequent in
toxic texts, each weighted by its smoothed log-odds. Phrases of a term and a neighbouring word that occur in clean
texts become exceptions; hits inside them do not count. A text's sum of weights, by itself and divided by the text's
length, goes through a logistic function fitted on the same rows.

The fit sees at most `sample` labelled documents, those with the least hashed ids, as whole texts; of copies and near copies
among them, told by two least hashes over all runs of `RUN` words, it sees one. A term must be in `SUPPORT` of the toxic
texts, a phrase in as many clean ones and no toxic one, so rarer ones are not learned; counts meet by term, and the driver gets
the `terms` best terms and as many of the most frequent phrases, so of a lexicon that would be larger the weakest are not
learned. All this bounds what is learned, not what is scored: every text is scored as a whole.

Edge cases: null and empty texts have no hits and get the score of such; null doc_ids are kept and never held out;
without labelled rows of both kinds the lexicon is empty and scores are 0; a doc_id that repeats in the labels counts as toxic
if any of its rows says so; rows that repeat a doc_id are scored each, and the least text of them is learned from. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import mix, shingles, words

#: Labelled documents that the fit may see; terms, and phrases, of a lexicon.
SAMPLE = 12_000
TERMS = 3_000
#: Toxic texts that a term must be in (and clean ones that a phrase must be in), and a term's least log-odds.
SUPPORT = 4
ODDS = 2.0
LENGTHS = (4, 5, 6)
#: Words of the runs by which copies are told.
RUN = 5

#: Look-alike letters (fixed values).
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ո": "n", "օ": "o", "ս": "u", "հ": "h",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
} | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})
_LOOKALIKE = re.compile("[" + "".join(map(chr, LOOKALIKES)) + "]")
#: Digits and signs that stand for letters (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
_ASCII = bytes(ord(DIGITS.get(chr(c), chr(c))) if c < 128 else c for c in range(256))

_WORD = re.compile(r"[^\W\d_]+")
_LETTER, _AFTER = re.compile(r"[^\W\d_]"), re.compile(r" [^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII).decode()
    if _LOOKALIKE.search(text):
        text = text.translate(LOOKALIKES).lower()
    for a, b in DIGITS.items():
        text = text.replace(a, b)
    return text


def candidates(text: str) -> set[str]:
    """Terms of a text: `word.` for a whole word, `stem` for the beginning of one."""
    out: set[str] = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= 3:
            out.add(w + ".")
            out.update(w[:n] for n in LENGTHS if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Bounded by its numbers of terms and exceptions, so it may travel with tasks."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = ()

    def automaton(self):
        import ahocorasick

        by: dict[str, list[tuple[int, str, float]]] = {}
        for term, w in self.weights.items():
            bare = term.removesuffix(".")
            by.setdefault(bare, []).append((len(bare), "word" if term.endswith(".") else "stem", w))
        for phrase in self.exceptions:
            bare = fold(phrase)
            by.setdefault(bare, []).append((len(bare), "exception", 0.0))
        a = ahocorasick.Automaton()
        for bare, kinds in by.items():
            a.add_word(bare, kinds)
        if by:
            a.make_automaton()
        return a if by else None


def hits(automaton, text: str) -> tuple[list[tuple[int, int, float]], int]:
    """Hits (start, end, weight) outside exceptions, the heaviest of each word; the text's number of spaces and line ends, plus 1."""
    text = fold(text)
    length = text.count(" ") + text.count("\n") + 1
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, kinds in automaton.iter(text):
        end = last + 1
        for size, kind, w in kinds:
            start = end - size
            if start and text[start - 1].isalpha():
                continue
            if kind != "stem" and end < len(text) and text[end].isalpha():
                continue
            if kind == "exception":
                spared.append((start, end))
            elif w > found.get(start, (0, 0.0))[1]:
                found[start] = (end, w)
    spared.sort()
    starts, reach = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return not i or reach[i - 1] < b

    return [(a, b, w) for a, (b, w) in sorted(found.items()) if free(a, b)], length


def features(own: list[tuple[int, int, float]], words: int) -> list[float]:
    total = sum(w for _, _, w in own)
    return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), math.log(words + 1)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Newton's method on the penalised likelihood."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the least of two hashes over all its runs of RUN words; texts of J in common agree in each by a chance of J."""
    for batch in shared.pieces(batches, 64):
        w = words([(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], lower=True)
        own, at = shingles(w, RUN)
        least = []
        for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
            mixed = np.append(mix(own ^ salt), ~np.uint64(0))
            least.append(np.where(at[1:] > at[:-1], np.minimum.reduceat(mixed, np.minimum(at[:-1], len(own))), 0).astype(np.uint64).view(np.int64)[: batch.num_rows])
        yield pa.record_batch({"doc_id": batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), "toxic": batch.column(batch.schema.get_field_index("toxic")), "one": least[0], "two": least[1]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Lexicon:
    """Lexicon, exceptions and logistic function from the labelled rows that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    seen = shared.kept(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled-all")
    # Copies would make any word of theirs a term: of those one is learned from.
    told = seen.mapInArrow(_prints, "doc_id long, toxic int, one long, two long")
    for c in ("one", "two"):
        told = told.groupBy("toxic", c).agg(F.min_by(F.struct(*[x for x in told.columns if x not in ("toxic", c)]), "doc_id").alias("x")).select("toxic", "x.*")
    rows = shared.kept(seen.join(F.broadcast(told.select("doc_id")), "doc_id").select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not toxic or not clean:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y == 1].update(candidates(text))
        for kind, c in n.items():
            keys = list(c)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                counts = pa.array([c[k] for k in part], pa.int64())
                none = pa.array(np.zeros(len(part), np.int64))
                yield pa.record_batch({"term": part, "bad": counts if kind else none, "good": none if kind else counts})

    found = rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    best = found.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy(F.desc(F.col("odds") * F.log1p("bad")), "term").limit(terms).collect()
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in best})
    if not lexicon.weights:
        return lexicon

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, words = hits(automaton, text)
                folded, phrases = fold(text), []
                for a, b, _ in own:
                    phrases += beside(folded, a, b)
                out.append((1 if y == 1 else 0, features(own, words), sorted(set(phrases))))
            yield pa.record_batch({"y": pa.array([o[0] for o in out], pa.int32()), "x": pa.array([o[1] for o in out], pa.list_(pa.float64())), "phrases": pa.array([o[2] for o in out], pa.list_(pa.string()))})

    seen = shared.kept(rows.mapInArrow(look, "y int, x array<double>, phrases array<string>"), "hits")
    phrases = seen.select("y", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    spared = phrases.where((F.col("bad") == 0) & (F.col("n") >= SUPPORT)).orderBy(F.desc("n"), "phrase").limit(terms).collect()
    lexicon.exceptions = [r["phrase"] for r in spared]
    if spared:  # hits inside exceptions are gone: the features are read anew
        seen = shared.kept(rows.mapInArrow(look, "y int, x array<double>, phrases array<string>"), "hits")
    table = seen.select("y", "x").toPandas()  # `sample` rows of a few numbers
    lexicon.coef = tuple(logistic(np.array(table["x"].tolist()), table["y"].to_numpy(float)).tolist())
    return lexicon


def beside(folded: str, a: int, b: int) -> list[str]:
    """The term at a to b, to the end of its word, with the whole word before it and with the whole word after it, where a single space parts them."""
    while b < len(folded) and folded[b].isalpha():
        b += 1
    first = a - 1
    while first > 0 and _LETTER.match(folded, first - 1):
        first -= 1
    after = _AFTER.match(folded, b)
    before = a > 0 and folded[a - 1] == " " and first < a - 1
    return ([folded[first:b]] if before else []) + ([folded[a : after.end()]] if after else [])


_SCORED = "doc_id long, score double, n_hits long"


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of each row of docs (doc_id, text)."""
    shared.slim(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1).to_pylist():
                own, words = hits(automaton, text) if automaton and text else ([], 1)
                z = sum(a * b for a, b in zip(lexicon.coef, features(own, words), strict=True)) if lexicon.coef else -math.inf
                scores.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                counts.append(len(own))
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "n_hits": pa.array(counts, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCORED).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def passed(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    shared.slim(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                own, words = hits(automaton, text) if automaton and text else ([], 1)
                z = sum(a * b for a, b in zip(lexicon.coef, features(own, words), strict=True)) if lexicon.coef else -math.inf
                keep.append(z < math.log(threshold / (1 - threshold)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
