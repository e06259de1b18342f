"""Groups of spelling variants: words that one inserted, deleted or replaced code point apart, the rarer pointing to the more frequent.

Words are counted over the corpus. Near pairs come from positional q-grams (q = 2, the word between two marks, so a word of L code points has
L + 1): one edit leaves at least max(L, L') - 1 of them in common, none moved by more than one place.

To keep that local, words meet in shards: an edit lies in one half of a word, so the other half is equal, at the start or at
the end. A word of L code points is in the shards (L, start, its first L // 2), (L, end, the rest), and, as the longer word of a pair, in those of
L - 1. A cell of a shard (`shards.cells`, bounded in size) is an inverted index of the q-grams outside the common half, by gram, place and length; a word merges the
postings of its grams, in order of the words (a heap merge of the shorter ones, the longer ones being looked up), for the lengths and at the places that one
edit allows, and words met often enough to reach the overlap bound are verified. A pair is met in one shard; where an insertion falls between the halves, it counts in the first.

Each cell adds up what a word has near it, so what leaves a cell are rows for words, not for pairs.

Edge cases: null and empty texts have no runs; a null doc_id is hashed as the empty string; rows that repeat a document
count each time; ties of frequency go to the smaller word in code-point order; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, shared

LEAST_LENGTH, LEAST_COUNT, TYPO = 5, 3, 97
#: Words of a cell, and distinct words that a task counts before it hands them on.
LIMIT, HELD = 4096, 250_000
#: Code points of a text that are searched for runs at once.
BLOCK = 1 << 20
_RUN, _GAP = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_START, _END = "\x02", "\x03"


def begun(doc_id: int | None) -> int:
    """The hash of what stands before a document's runs."""
    return zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())


def altered(before: int, run: str, typo: int = TYPO) -> str:
    """A lower-cased run, without one code point where the hash of its document (`begun`) and run says so."""
    h = zlib.crc32(run.encode(), before)
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs(text: str | None, block: int = BLOCK) -> Iterator[list[str]]:
    """Runs of letters, A-Z lower-cased, of one block of the text after another."""
    text, at = text or "", 0
    while at < len(text):
        end = _GAP.search(text, at + block)
        to = end.start() if end else len(text)
        yield _RUN.findall(text[at:to].encode().lower().decode())
        at = to


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for batch in shared.pieces(batches, 64):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                before = begun(doc_id)
                for found in runs(text.as_py()):
                    for word, n in Counter(found).items():
                        made = altered(before, word, typo)
                        if len(made) >= least_length:
                            held[made] += n
                    if len(held) >= HELD:
                        yield out()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grams(word: str, length: int, side: int) -> Iterator[tuple[str, int]]:
    """(gram, place) of the q-grams that are not within the half common to a shard of words of `length` code points: the first half
    where side = 0, the rest where side = 1. Places count from the start of the word."""
    marked = _START + word + _END
    half = length // 2
    if side == 0:
        return ((marked[i : i + 2], i) for i in range(half, len(word) + 1))
    return ((marked[i : i + 2], i) for i in range(len(word) + 1 - (length - half)))


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Index:
    """The inverted index of a cell: words of `length` and one more that agree in one half. It is built when it is first asked."""

    def __init__(self, length: int, side: int) -> None:
        self.length, self.side, self.half = length, side, length // 2
        self.words: list[str] = []
        self.postings: dict[tuple[str, int, int], list[int]] = {}
        self.lengths: set[int] = set()
        self.indexed = 0
        #: Grams of the common half, which all words of the cell share.
        self.common = self.half if side == 0 else length - self.half

    def add(self, word: str) -> None:
        self.words.append(word)
        self.lengths.add(len(word))

    def _built(self) -> dict[tuple[str, int, int], list[int]]:
        for number in range(self.indexed, len(self.words)):
            word = self.words[number]
            for gram, place in grams(word, self.length, self.side):
                self.postings.setdefault((gram, place, len(word)), []).append(number)
        self.indexed = len(self.words)
        return self.postings

    def find(self, word: str) -> Iterator[int]:
        """Numbers of the indexed words that are near `word` and belong to this shard."""
        # Of two longer words the shards of their own length have the pair.
        asked = {self.length} if len(word) > self.length else {self.length, self.length + 1}
        for other in asked & self.lengths:
            postings, moves = self._built(), {0, other - len(word)}
            lists = [p for gram, place in grams(word, self.length, self.side) for move in moves if (p := postings.get((gram, place + move, other)))]
            bound = max(1, max(len(word), other) - 1 - self.common)
            if len(lists) < bound:
                continue
            # What is in `bound` lists is in one of all but bound - 1: the shorter ones are merged, the longer ones looked up.
            lists.sort(key=len)
            merged, rest = lists[: len(lists) - bound + 1], lists[len(lists) - bound + 1 :]
            for number, found in itertools.groupby(heapq.merge(*merged)):
                met = sum(1 for _ in found)
                for held in rest:
                    if met >= bound:
                        break
                    at = bisect.bisect_left(held, number)
                    met += at < len(held) and held[at] == number
                if met >= bound and near(word, self.words[number]) and self.owns(word, self.words[number]):
                    yield number

    def owns(self, a: str, b: str) -> bool:
        """Whether a near pair is this shard's: the end's only where the starts differ."""
        return self.side == 0 or a[: self.half] != b[: self.half]


def shard_keys(word: F.Column, least_length: int) -> F.Column:
    """The shards of a word, as structs (length, side, half); none is of a length that no word has."""
    n = F.length(word)

    def two(length: F.Column) -> list[F.Column]:
        half = F.floor(length / 2).cast("int")
        start = F.struct(length.alias("length"), F.lit(0).alias("side"), F.substring(word, F.lit(1), half).alias("half"))
        return [start, F.struct(length.alias("length"), F.lit(1).alias("side"), F.right(word, length - half).alias("half"))]

    return F.when(n > least_length, F.array(*two(n), *two(n - 1))).otherwise(F.array(*two(n)))


def near_words(words: DataFrame, limit: int = LIMIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n_near, best struct<neg_n, form>) of the words (word, n) that have near ones: how many, and the one of largest n."""
    keys = ["length", "side", "half"]
    rows = words.select("word", "n", F.explode(shard_keys(F.col("word"), least_length)).alias("s")).select("s.*", "word", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, int, int, str]]:
            index, alone, counts, best = Index(0, 0), False, [], []

            def summed() -> Iterable[tuple[str, int, int, str]]:
                return ((w, m, *b) for w, m, b in zip(index.words, counts, best, strict=True) if m)

            sizes: list[int] = []
            for cell, (word, n, asks) in shards.groups(batches, keys, ["word", "n"]):
                if cell:
                    yield from summed()
                    index, alone, counts, best, sizes = Index(cell[0], cell[1]), cell[-2] == cell[-1], [], [], []
                met, top = 0, (0, "")
                if asks or alone:
                    for i in index.find(word):
                        met, counts[i] = met + 1, counts[i] + 1
                        other = (-sizes[i], index.words[i])
                        top, best[i] = min(top, other) if met > 1 else other, min(best[i], (-n, word)) if counts[i] > 1 else (-n, word)
                if not asks:
                    index.add(word)
                    counts.append(met)
                    best.append(top)
                    sizes.append(n)
                elif met:
                    yield word, met, *top
            yield from summed()

        rows = found()
        while some := list(itertools.islice(rows, 10_000)):
            yield pa.record_batch({c: pa.array(x, t) for c, x, t in zip(("word", "n_near", "neg_n", "form"), zip(*some, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    parts = shards.cells(rows, keys, "word", limit).mapInArrow(search, "word string, n_near long, neg_n long, form string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("neg_n", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form): where following forms ends. Frequencies at least double with each step, so the way is
    short; each round halves it."""
    ends, at = shared.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = ends.select(F.col("word").alias("via"), F.col("root").alias("over"))
        step = ends.join(over, F.col("root") == F.col("via"), "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved"))
        new, new_at = shared.stored(step, "roots")
        shared.drop(ends.sparkSession, at)
        ends, at = new.select("word", "root"), new_at
        if new.where("moved").isEmpty():
            return ends


def variants(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text)."""
    with shared.scratch(docs.sparkSession, "spelling"):
        words = shared.kept(vocabulary(docs), "vocabulary")
        beside = words.join(near_words(words, limit), "word", "left")
        real = -F.col("best.neg_n") >= 2 * F.col("n")
        known = shared.kept(beside.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(real, F.col("best.form")).alias("form"), F.when(real, -F.col("best.neg_n")).alias("form_n")), "forms")
        ends = roots(known.where("form IS NOT NULL").select("word", "form"))
        return shared.kept(known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: Near words by what they are without one of their code points: equal at one place, or one the other without a code point.
ORACLE = f"""WITH RECURSIVE r AS (SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM r GROUP BY id, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(bytes) // 2), lambda k: ('0x' || substr(bytes, (2 * k + 1)::bigint, 2))::bigint)), lambda c, b: xor(({_crc_table()}::bigint[])[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM d),
m AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::bigint AS n FROM m WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
b AS (SELECT a AS word, count(*)::bigint AS n_near, first(b ORDER BY v.n DESC, b) AS best, max(v.n) AS best_n FROM p JOIN v ON p.b = v.word GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS here FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM f JOIN w USING (word) JOIN f l ON l.word = w.here WHERE l.form IS NULL"""
