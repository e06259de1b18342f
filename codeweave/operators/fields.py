"""Full-text search over several fields of a document, from an index whose blocks a search can skip.

A term in a field of a document is worth `K1 + 1` at most there, by its frequency and the field's length; with the field's weight and the term's
rarity that is its part of the score, and the score is their sum. The index has a list for each term and field, cut into levels by what
an entry is worth and into blocks of about `BLOCK` entries within a level. What a level holds is known from the heads of its blocks, so a search
reads levels from the best on, and stops when what is left could not lift a document that it has not met into the best k.
Documents that it has met and that could still be among these are then scored on their fields.

Blocks come from hashes of ids, not from ranks: no task holds the list of a frequent term. Null fields are empty, null ids are no part of an index; ids are unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import spread
from .search import K1, TERM_PATTERN, B, counted, is_term
from .traverse import settled
from .vector_index import pool

#: Fields of a node that are searched, with their weights (fixed values).
NODE_FIELDS = {"name": 1.0, "file_path": 1.0, "first_line": 1.0, "documentation": 1.0, "source_code": 1.0}
#: Entries of a block, about; levels of worth; entries that a search reads first.
BLOCK, LEVELS, FIRST = 128, 32, 512
_STEP = (K1 + 1) / LEVELS
#: Lists of several blocks that are sent to all tasks at most.
MANY = 200_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), F.lit(0))


def worth(tf: Column, length: Column, mean: Column) -> Column:
    """What a term's frequency in a field of a length is worth, below K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class Level:
    """A level of a list: what an entry adds to a score at most, and how many entries and blocks there are."""

    term: str
    field: str
    level: int
    docs: int
    blocks: int
    most: float


class FieldIndex:
    """An index in a folder; `read` and `held` say how many blocks the last search read, and how many its lists have."""

    def __init__(self, spark: SparkSession, folder: str, weights: dict[str, float]) -> None:
        self.spark, self.folder, self.weights = spark, folder, weights
        self.read = self.held = 0
        self.sizes = {r["field"]: (r["docs"], r["mean"]) for r in spark.read.parquet(f"{folder}/fields").collect()}  # a row for each field

    @classmethod
    def build(cls, docs: DataFrame, folder: str, weights: dict[str, float] | None = None, block: int = BLOCK) -> FieldIndex:
        """Indexes the rows of docs (id and the fields)."""
        weights = NODE_FIELDS if weights is None else weights
        spark = docs.sparkSession
        own = docs.where("id IS NOT NULL").select("id", *weights)
        cut = spread(own, "id").select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _terms(F.col(f)).alias("terms")) for f in weights])).alias("_f")).select("id", "_f.field", "_f.terms")
        counted(cut, F.col("terms"), "id", "field").withColumn("tf", F.col("tf").cast("double")).write.parquet(f"{folder}/entries")
        entries = spark.read.parquet(f"{folder}/entries")
        # Documents are counted, words summed up from the entries: no text is cut into terms twice.
        total = own.count()
        words = {r["field"]: r["words"] for r in entries.groupBy("field").agg(F.sum("tf").alias("words")).collect()}  # a row for each field
        sizes = [(f, total, max(words.get(f, 0.0) / total, 1e-9)) for f in weights] if total else []
        spark.createDataFrame(sizes, "field string, docs long, mean double").coalesce(1).write.parquet(f"{folder}/fields")
        mean = F.lit(1.0)
        for field, _, m in sizes:
            mean = F.when(F.col("field") == field, m).otherwise(mean)
        level = F.least(F.lit(LEVELS - 1), F.floor((K1 + 1 - worth(F.col("tf"), F.col("len"), mean)) / _STEP)).cast("int")
        placed = entries.select("term", "field", level.alias("level"), "id", "tf", "len")
        # Only lists of several blocks are dealt to them; these are few, and sent to all tasks while they are.
        lists = placed.groupBy("term", "field", "level").agg(F.count("*").alias("docs")).where(F.col("docs") > block)
        lists.withColumn("blocks", F.ceil(F.col("docs") / block).cast("int")).drop("docs").write.parquet(f"{folder}/many")
        many = spark.read.parquet(f"{folder}/many")
        many = F.broadcast(many) if many.count() <= MANY else many
        number = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0))
        dealt = placed.join(many, ["term", "field", "level"], "left").select("term", "field", "level", number.alias("block"), "id", "tf", "len")
        # Entries move once, to their place in the order of the index, and are put into blocks there.
        order = ["term", "field", "level", "block"]
        blocks = dealt.repartitionByRange(*order).groupBy(*order).agg(F.count("*").alias("docs"), F.collect_list(F.struct("id", "tf", "len")).alias("entries"))
        blocks.sortWithinPartitions(*order).write.parquet(f"{folder}/blocks")
        return cls(spark, folder, weights)

    def _levels(self, terms: list[str]) -> tuple[list[Level], dict[tuple[str, str], float]]:
        """Levels of the terms' lists, best first, and what each list's worth is multiplied with."""
        heads = self.spark.read.parquet(f"{self.folder}/blocks").where(F.col("term").isin(terms) & F.col("field").isin(list(self.weights)))
        rows = heads.groupBy("term", "field", "level").agg(F.sum("docs").alias("docs"), F.count("*").alias("blocks")).collect()  # at most LEVELS for each term and field
        df: dict[tuple[str, str], int] = {}
        for r in rows:
            df[r["term"], r["field"]] = df.get((r["term"], r["field"]), 0) + r["docs"]
        factor = {}
        for (term, field), n in df.items():
            total = self.sizes[field][0]
            factor[term, field] = self.weights[field] * math.log(1 + (total - n + 0.5) / (n + 0.5))
        found = [Level(r["term"], r["field"], r["level"], r["docs"], r["blocks"], factor[r["term"], r["field"]] * (K1 + 1 - r["level"] * _STEP)) for r in rows]
        return sorted(found, key=lambda x: (-x.most, x.term, x.field)), factor

    def search(self, docs: DataFrame, terms: list[str], k: int, first: int = FIRST) -> DataFrame:
        """(id, score) of the k best of docs, which are those that the index was built from, best first, ties in order of id."""
        wanted = sorted({t.lower() for t in terms})
        levels, factor = self._levels(wanted)
        self.held = sum(x.blocks for x in levels)
        none = docs.select("id", F.lit(0.0).alias("score")).limit(0)
        if not levels or k <= 0:
            self.read = 0
            return none
        budget = max(first, k)
        while True:
            n = seen = 0
            while n < len(levels) and seen < budget:
                seen, n = seen + levels[n].docs, n + 1
            left: dict[tuple[str, str], float] = {}
            for x in levels[n:]:
                left[x.term, x.field] = max(left.get((x.term, x.field), 0.0), x.most)
            self.read = sum(x.blocks for x in levels[:n])
            met = self._met(levels[:n], factor)
            best = [r["part"] for r in met.orderBy(F.desc("part")).limit(k).select("part").collect()]
            least = best[-1] if len(best) == k else -1.0
            # What is not met yet gets less than the k-th of what is: with room for rounding.
            if n == len(levels) or sum(left.values()) < least - 1e-6:
                break
            budget *= 4
        more = F.lit(0.0)
        for (term, field), most in sorted(left.items()):
            more = more + F.when(F.array_contains("lists", f"{field}:{term}"), 0.0).otherwise(most)
        ids = settled(met.where(F.col("part") + more >= least - 1e-6).select("id"))
        scored = docs.join(ids, "id", "left_semi").select("id", F.round(self._score(factor), 9).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def _met(self, levels: list[Level], factor: dict[tuple[str, str], float]) -> DataFrame:
        """(id, part, lists): the documents of the levels, what these add to their scores, and the lists that they are met in."""
        deepest: dict[tuple[str, str], int] = {}
        for x in levels:
            deepest[x.term, x.field] = max(deepest.get((x.term, x.field), -1), x.level)
        keep, times, mean = F.lit(False), F.lit(0.0), F.lit(1.0)
        for (term, field), level in sorted(deepest.items()):
            own = (F.col("term") == term) & (F.col("field") == field)
            keep = keep | (own & (F.col("level") <= level))
            times = F.when(own, factor[term, field]).otherwise(times)
        for field, (_, m) in sorted(self.sizes.items()):
            mean = F.when(F.col("field") == field, m).otherwise(mean)
        rows = self.spark.read.parquet(f"{self.folder}/blocks").where(keep)
        entries = rows.select(times.alias("_times"), mean.alias("_mean"), F.concat_ws(":", "field", "term").alias("_list"), F.explode("entries").alias("_e"))
        part = F.col("_times") * worth(F.col("_e.tf"), F.col("_e.len"), F.col("_mean"))
        return entries.groupBy(F.col("_e.id").alias("id")).agg(F.sum(part).alias("part"), F.collect_set("_list").alias("lists"))

    def _score(self, factor: dict[tuple[str, str], float]) -> Column:
        score = F.lit(0.0)
        for (term, field), times in sorted(factor.items()):
            terms = _terms(F.col(field))
            tf = F.size(F.filter(terms, is_term(term))).cast("double")
            score = score + F.when(tf > 0, F.lit(times) * worth(tf, F.size(terms), F.lit(self.sizes[field][1]))).otherwise(0.0)
        return score


def scoped_search(index: FieldIndex, docs: DataFrame, terms: list[str], k: int, own: DataFrame | None = None) -> DataFrame:
    """(id, score) of the k best; with `own` (id), a repository's, of those in it among the pool of candidates of all."""
    if own is None:
        return index.search(docs, terms, k)
    return index.search(docs, terms, pool(k, True)).join(own.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(k)
