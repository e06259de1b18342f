"""Similarity join of documents on the Jaccard coefficient of their shingles, by prefixes of token combinations.

Tokens are hashes of runs of words. Documents whose sets are equal are one class and go on as one representative. All
tokens' document frequencies are counted over the corpus (`chunks.ask`); tokens are ordered from rare to frequent.
Two sets that are similar enough share at least K tokens among the first |s| - ceil(t |s|) + K of each, t being the
coefficient. With prefixes extended to K = C + 1, tokens being dealt to C classes by a hash:

* a shared token of the rare ranks is found by its own index entry;
* where none of the shared tokens in the prefixes is rare, two of them are in one class, so the pairs of frequent tokens
  within each class are indexed.

C grows with the set, so that a class has about `PER_CLASS` tokens of the prefix and the pairs grow with the prefix, not with
its square; it goes by powers of two of the size, and a set that may link with sets of the next lower power is indexed for that,
too. Sets of which too few tokens occur elsewhere to link with anything have no entry.

Tokens of one document alone have no entry. Candidates then are verified on whole sets. Entries are not expanded to all
their pairs: first each document is compared with one partner of each entry, by which most of a group of copies
becomes one component; then only pairs of one entry that are still in different components are compared, if their sizes,
their numbers of tokens that other documents have, too, and parities of their tokens' hashes allow the overlap that a
link takes. So every link between different components is found, and a group of n copies costs about n
comparisons. Entries have an order, and a pair is made in the first entry that its documents share, as far as the `FIRST` first
entries of each tell. Pairs of one entry are made within neighbouring ranges of sizes alone. What remains at worst is many
unlike texts of like sizes that nearly all consist of passages others have, too: pairs of one entry of theirs are compared
by sizes, counts and parities, spread over tasks by the entry, and the sets of few are read.

Edge cases: null and empty texts, and texts without words, have empty sets and are alone; rows that repeat a doc_id
are one node of the graph, linked with what any of them is linked with; null doc_ids are alone, with a null component; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import shared
from .words import mix, shingles, words

#: Documents from which on a token counts as frequent.
FREQUENT = 64
#: Tokens of a prefix that a class has, about.
PER_CLASS = 12
#: First entries of a document that go with its rows, so that a pair is not made again in later ones.
FIRST = 8
_SALT = {"one": np.uint64(0x243F6A8885A308D3), "two": np.uint64(0x13198A2E03707344), "class": np.uint64(0xA4093822299F31D0)}


def _sets(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = words([t.encode() for t in row["texts"].as_py()], lower=True)
    return shingles(w, k)


def _classes(df: np.ndarray) -> np.ndarray:
    """0 for one document, then by powers of two."""
    return np.where(df > 1, 1 + np.floor(np.log2(np.maximum(df - 1, 1))), 0).astype(np.uint8)


def classes_of(size: int, percent: int, per_class: int = PER_CLASS) -> list[tuple[int, int]]:
    """(power of two, number of classes) for each range of sizes in which a set of this size is indexed: its own, and that
    of the least set it may link with."""
    powers = {size.bit_length(), (-(-percent * size // 100)).bit_length()}
    return [(p, max(1, (100 - percent) * (1 << (p - 1)) // (100 * per_class))) for p in sorted(powers)]


def entries(tokens: np.ndarray, classes: np.ndarray, percent: int, frequent: int = FREQUENT, per_class: int = PER_CLASS) -> np.ndarray:
    """Index entries of one set."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, classes))
    ranges = classes_of(n, percent, per_class)
    base = n - -(-percent * n // 100) + 1
    first = int(_classes(np.array([frequent]))[0])
    prefix = order[: base + max(c for _, c in ranges)]
    rare = tokens[prefix][(classes[prefix] > 0) & (classes[prefix] < first)]
    out = [mix(rare ^ _SALT["one"])]
    for power, parts in ranges:
        prefix = order[: base + parts]
        often = tokens[prefix][classes[prefix] >= first]
        part = mix(often ^ _SALT["class"]) % np.uint64(parts)
        turn = np.lexsort((often, part))
        often, part = often[turn], part[turn]
        salt = mix(np.array([power], np.uint64) ^ _SALT["two"])
        for gap in range(1, int(np.bincount(part.astype(np.int64)).max(initial=0))):
            same = part[gap:] == part[:-gap]
            out.append(mix(mix(often[:-gap][same] ^ salt) + often[gap:][same]))
    return np.concatenate(out)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Eight numbers of 64 bits: for each of 512 cells of a hash, whether an odd number of tokens falls there. Bits in
    which two sets differ are at most as many as the tokens that only one of them has."""
    counts = np.bincount((mix(tokens ^ _SALT["two"]) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(counts.astype(np.uint8)).view("<i8")


BITS = [f"bits{i}" for i in range(8)]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(nodes: DataFrame, links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the least node that links (a, b) reach, for each of `nodes` (node).

    Labels fall to the least label of a neighbour and then jump along labels, so long chains halve each round; each
    round is a table in the shared folder, and the one before it goes.
    """
    spark = nodes.sparkSession
    both = shared.kept(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-links")
    labels, at = shared.stored(nodes.select("node", F.col("node").alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        hop, hop_at = shared.stored(step, f"{name}-step")
        over = hop.select(F.col("node").alias("n"), F.col("next").alias("over"))
        jumped = hop.join(over, F.col("next") == F.col("n"), "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("over", "next")).alias("label"))
        new, new_at = shared.stored(jumped, name)
        shared.drop(spark, at, hop_at)
        labels, at = new.select("node", "label"), new_at
        if new.where("label <> old").isEmpty():
            return labels


def ordered(docs: str) -> F.Column:
    """A key of the entry `sig` that has `docs` documents: entries of many come first, by powers of two, the rest of the key is the
    entry's own. Should two entries have one key, their documents meet."""
    return F.shiftleft(F.lit(63) - F.floor(F.log2(docs)).cast("long"), 57).bitwiseOR(F.col("sig").bitwiseAND(F.lit((1 << 57) - 1)))


def first_entries(rows: DataFrame, most: int) -> DataFrame:
    """(rep, firsts): the `most` least entries of each document of rows (rep, entry). They combine on the map side by slots: the least of
    each slot of a hash, so what is kept is bounded, and is some of the first entries where slots are shared."""
    slot = F.pmod(F.hash("entry"), F.lit(most))
    least = rows.groupBy("rep").agg(*[F.min(F.when(slot == i, F.col("entry"))).alias(f"_{i}") for i in range(most)])
    return least.select("rep", F.array_compact(F.array(*[F.col(f"_{i}") for i in range(most)])).alias("firsts"))


def fits(there: Callable[[str], str], percent: int) -> F.Column:
    """Sizes near enough; enough tokens that are not the documents' own for the overlap that a link takes; few enough
    cells whose parity differs."""
    n, m = F.col("n"), F.col(there("n"))
    far = F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(there(BITS[0]))))
    for c in BITS[1:]:
        far = far + F.bit_count(F.col(c).bitwiseXOR(F.col(there(c))))
    own = F.least("shared", there("shared"))
    # overlap >= percent * (n + m) / (100 + percent), and n + m - 2 * overlap tokens differ
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (own * (100 + percent) >= (n + m) * percent) & (far * (100 + percent) <= (n + m) * (100 - percent))


def crossed(apart: DataFrame, percent: int, most: int = FIRST) -> DataFrame:
    """(a, b): pairs of rows (entry, rep, n, shared, label, bits) of one entry and different labels that may link.

    A pair that meets in several entries is made in the first of them, or in few. Each document carries some of its first entries; where two
    have one of these in common, they meet there, and later entries leave them out. At the first entry of all that they share there is none
    before it, so no pair is lost.
    """
    apart = apart.join(shared.kept(first_entries(apart, most), "firsts"), "rep")
    # Sizes of sets that link are in one range or in neighbouring ones.
    span = F.floor(F.log("n") / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n")
    near = F.array("span", F.col("span") - 1) if percent < 100 else F.array("span")
    mine = apart.withColumn("span", span)
    other = mine.select("entry", F.explode(near).alias("span"), F.col("span").alias("span2"), *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "shared", "label", "firsts", *BITS)])
    once = (F.col("span") < F.col("span2")) | (F.col("rep") < F.col("rep2"))
    here = F.coalesce(F.array_min(F.array_intersect("firsts", "firsts2")) >= F.col("entry"), F.lit(True))
    cross = mine.join(other, ["entry", "span"]).where(once & (F.col("label") != F.col("label2")) & fits(lambda c: f"{c}2", percent) & here)
    return cross.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


def join(docs: DataFrame, k: int = 4, percent: int = 85, frequent: int = FREQUENT, per_class: int = PER_CLASS, few: int = C.FEW, bundle: int = C.BUNDLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    Sets of runs of k words link where their Jaccard coefficient is at least percent / 100, which is above a half.
    """
    if not 50 < percent <= 100:
        raise ValueError("the coefficient must be above a half")
    with shared.scratch(docs.sparkSession, "sets", "classes", "stars", "components", "labelled"):
        return _join(docs, k, percent, frequent, per_class, few, bundle)


def _join(docs: DataFrame, k: int, percent: int, frequent: int, per_class: int, few: int, bundle: int) -> DataFrame:
    spark = docs.sparkSession
    chunked = C.cut(docs)
    total = chunked.agg(F.sum("n_words")).first()[0] or 0

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            tokens, at = _sets(row, k)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ s))]) for s in (np.uint64(0), _SALT["one"])]
            prints = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
            ids = row["ids"].as_py()
            base = row["chunk"].as_py()
            yield pa.record_batch({"chunk": pa.array([base] * len(ids), pa.int64()), "place": pa.array(np.arange(len(ids), dtype=np.int32)), "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(np.diff(at).astype(np.int64)), "p": pa.array(prints[0][: len(ids)]), "q": pa.array(prints[1][: len(ids)])})

    described = shared.kept(chunked.mapInArrow(describe, "chunk long, place int, doc_id long, n_shingles long, p long, q long"), "sets")
    real = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shared.kept(real.groupBy("p", "q", "n_shingles").agg(F.min(F.struct("doc_id", "chunk", "place")).alias("rep")), "classes")
    reps = shared.kept(classes.select(F.col("rep.chunk").alias("chunk"), F.col("rep.place").alias("place"), F.col("rep.doc_id").alias("rep")), "reps")
    chosen = shared.folder(spark, "chosen")

    def choose(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "part": pa.array([0], pa.int32()), "blob": pa.array([C.squeeze(np.sort(table["place"].to_numpy()).astype("<i4").tobytes())], pa.binary())})

    C.gather(reps.groupBy("chunk").applyInArrow(choose, "chunk long, part int, blob binary"), chosen, "chosen")

    def own_sets(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a chunk's representatives, their bounds, and the representatives' places."""
        tokens, at = _sets(row, k)
        places = C.answers(chosen, row["chunk"].as_py()).view("<i4")
        sizes = at[places + 1] - at[places]
        ends = np.cumsum(sizes)
        pick = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[places] - (ends - sizes), sizes)
        return tokens[pick], np.concatenate([[0], ends]).astype(np.int64), places

    def keys_of(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        tokens, _, _ = own_sets(row)
        keys, counts = np.unique(tokens >> np.uint64(16), return_counts=True)
        return keys, [counts.astype(np.uint32)]

    def answer(keys: list[np.ndarray], beside: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [_classes(t) for t in C.totals(keys, [b[0] for b in beside])]

    question = C.Question(["<u4"], 48, keys_of, answer, C.merge_counts((1 << 32) - 1), C.spread_alike)
    counted = C.ask(chunked, question, total, "frequencies", few, bundle)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            chunk, ids = row["chunk"].as_py(), row["ids"].as_py()
            tokens, at, places = own_sets(row)
            if not len(places):
                continue
            _, back = np.unique(tokens >> np.uint64(16), return_inverse=True)
            cls = C.answers(counted, chunk)[back]
            out: list[tuple[int, int, int, np.ndarray, bytes, np.ndarray]] = []
            for i, place in enumerate(places.tolist()):
                a, b = int(at[i]), int(at[i + 1])
                common = int(np.count_nonzero(cls[a:b]))
                # Whatever it links with, at least percent of its own tokens are in both.
                sig = entries(tokens[a:b], cls[a:b], percent, frequent, per_class) if common * 100 >= (b - a) * percent else ()
                if len(sig):
                    out.append((ids[place], b - a, common, sig, np.sort(tokens[a:b]).tobytes(), parities(tokens[a:b])))
            if out:
                sizes = np.array([len(o[3]) for o in out])
                blobs = [x for o in out for x in (o[4], *[None] * (len(o[3]) - 1))]
                columns = [np.repeat(np.array([o[j] for o in out], t), sizes) for j, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
                yield pa.record_batch({"rep": columns[0], "n": columns[1], "shared": columns[2], "sig": np.concatenate([o[3] for o in out]).view(np.int64), "tokens": pa.array(blobs, pa.binary()), **{c: np.repeat(np.array([o[5][j] for o in out]), sizes) for j, c in enumerate(BITS)}})

    indexed = shared.kept(chunked.mapInArrow(index, "rep long, n int, shared int, sig long, tokens binary, " + ", ".join(f"{c} long" for c in BITS)), "index")
    sets = shared.kept(indexed.where("tokens IS NOT NULL").select("rep", "tokens"), "tokens")
    rows = indexed.select("rep", "n", "shared", "sig", *BITS)
    # The partner of an entry's documents is the one that has the largest share of tokens in common with others: of a
    # text and its edited copies that is the text.
    partner = F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("rep")).alias("rep"), "n", "shared", *BITS))
    busy = rows.groupBy("sig").agg(F.count("*").alias("docs"), partner.alias("first")).where("docs > 1")
    postings = shared.kept(rows.join(busy.select("sig", (-F.col("first.rep")).alias("first"), F.col("first.n").alias("first_n"), F.col("first.shared").alias("first_shared"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in BITS]), "sig"), "postings")

    # A document that rows with several sets have holds their classes together.
    one = F.struct("p", "q", "n_shingles")
    several = described.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").select("doc_id")
    several = shared.small(shared.kept(several, "several"))
    held = real.join(several, "doc_id").join(classes.select("p", "q", "n_shingles", F.col("rep.doc_id").alias("rep")), ["p", "q", "n_shingles"])
    held = shared.kept(held.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "held")

    star = postings.where((F.col("rep") != F.col("first")) & fits(lambda c: f"first_{c}", percent)).select(F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")).distinct()
    tried, links = _verified(star, sets, percent)
    links = links.union(held)
    nodes = postings.select(F.col("rep").alias("node")).union(held.select("a")).union(held.select("b")).distinct()
    labels = components(nodes, links, "stars")

    # What is left: pairs of one entry in different components. Both sides keep the entry's key, so a popular entry is
    # split like any skewed join; entries within one component drop out before.
    known = postings.join(labels, F.col("rep") == F.col("node")).select("sig", "rep", "n", "shared", "label", *BITS)
    mixed = known.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sig")
    # Long passages that the same texts have make many entries of the same documents: one of these finds all their pairs.
    members = known.join(mixed, "sig").groupBy("sig").agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.hash("rep").cast("long")).alias("y"), F.min("rep").alias("least"), F.max("rep").alias("most"))
    chosen_sigs = members.groupBy("docs", "x", "y", "least", "most").agg(F.min("sig").alias("sig")).select("sig", ordered("docs").alias("entry"))
    apart = shared.kept(known.join(chosen_sigs, "sig"), "apart")
    rest = crossed(apart.drop("sig"), percent).distinct()
    rest = shared.kept(rest, "rest").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    _, more = _verified(rest, sets, percent)
    ends = components(nodes, links.union(more), "components") if not more.isEmpty() else labels

    owners = classes.select("p", "q", "n_shingles", F.col("rep.doc_id").alias("rep")).join(ends, F.col("rep") == F.col("node"), "left").select("p", "q", "n_shingles", F.coalesce("label", "rep").alias("component"))
    # Rows of such a document without words have no class; their document may have a component all the same.
    apart = several.join(ends, F.col("doc_id") == F.col("node")).select("doc_id", "label")
    named = described.join(owners, ["p", "q", "n_shingles"], "left").join(shared.small(shared.kept(apart, "labelled")), "doc_id", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "component", "doc_id")).alias("component_id"))


def kept_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that a document of smaller doc_id stands for: of each component the
    least doc_id stays, with all its texts. Documents without words, and null doc_ids, stay; of equal rows of one doc_id one stays."""
    found = shared.kept(join(docs, k, percent).select("doc_id", "component_id"), "components-of")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(shared.small(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs with their verdict, and those that link."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    tried = shared.kept(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, linked boolean"), "verified")
    return tried, tried.where("linked").select("a", "b")
