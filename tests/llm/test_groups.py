"""Spelling variants, the filter audit and SimHash trees against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from codeweave.llm import filter_audit, simhash_trees, spelling

from .helpers import SCHEMA, documents, prose

WORD = r"[^\x20\x09-\x0D]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Spelling variants


def brute_variants(pairs):
    n = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in n if v != w and edit(w, v)] for w in n}
    form = {w: min(b, key=lambda v: (-n[v], v), default=None) for w, b in beside.items()}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n}


def typos(rng, words, n):
    out = []
    for _ in range(n):
        w = rng.choice(words)
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aé×z") + w[at:], w[:at] + rng.choice("aéz") + w[at + 1 :], w.upper(), w + w[-1]])
        out.append(w)
    return out


@pytest.mark.parametrize("seed,limit", [(1, 4096), (2, 3), (3, 1)])
def test_spelling_variants(spark, seed, limit):
    rng = random.Random(seed)
    words = [w for w in ("".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60))]
    rows = [(i, rng.choice([" ", "-", "1"]).join(typos(rng, words, 150)), None, None, None, "x", 1, 0.5, 1, 7, 3, 2) for i in range(12)]
    rows += [rows[0], (50, None, *rows[0][2:]), (51, "", *rows[0][2:]), (None, rows[3][1], *rows[0][2:]), (None, "\n é 42", *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in spelling.variants(docs, limit).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants([r[:2] for r in rows])
    assert any(n_near > 2 for *_, n_near, _ in got) and any(form for _, form, *_ in got)


def test_roots_of_chains_of_forms(spark):
    words = ["qqqqqqq"[: 7 - i] + "zzzzzzz"[:i] for i in range(7)]
    docs = spark.createDataFrame([(i, " ".join([w] * (3 << i))) for i, w in enumerate(words)], "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants([tuple(r) for r in docs.collect()])
    assert len({r for _, f, r, *_ in got if f and f != r}) and max(n for *_, n, _, _ in got) == 192


def test_spelling_variants_of_nothing(spark):
    assert spelling.variants(documents(spark).limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


def test_spelling_variants_of_a_third_of_words_with_one_start(spark):
    words = ["commonstart" + "".join(x) for x in itertools.product("abcd", repeat=3)] + ["commonstartabcde", "other", "others", "othe"]
    docs = spark.createDataFrame([(i, " ".join(words[: 64 - 7 * i] + words[60:] * 3)) for i in range(6)], "doc_id long, text string")
    got = {tuple(r) for r in spelling.variants(docs, 8).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants([tuple(r) for r in docs.collect()])


def test_runs_are_the_same_in_any_blocks():
    text = "Éa bcd×efg hij-KLM\n" * 20
    whole = [w for b in spelling.runs(text) for w in b]
    assert all([w for b in spelling.runs(text, n) for w in b] == whole for n in (1, 2, 5, 17))


@pytest.mark.parametrize("length", [4, 5, 6, 9])
def test_a_near_pair_is_met_in_one_shard(length):
    rng = random.Random(length)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(length))
        at = rng.randrange(length + 1)
        for b in {a[:at] + rng.choice("abc") + a[at:], a[:at] + "c" + a[at + 1 :]}:
            if a == b or not spelling.near(a, b):
                continue
            met = 0
            for n, side in itertools.product((length - 1, length, length + 1), (0, 1)):
                half = n // 2
                there = [w for w in (a, b) if n <= len(w) <= n + 1]
                keys = {w[:half] if side == 0 else w[len(w) - (n - half) :] for w in there}
                if len(there) == 2 and len(keys) == 1:
                    index = spelling.Index(n, side)
                    index.add(a)
                    met += len(list(index.find(b)))
            assert met == 1, (a, b)


# Filter audit


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = []
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(WORD, text)
        failed.append({f for f, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)), strict=True) if bad})
    out, shapley = {}, Counter()
    for part in {s or "" for *_, s in docs}:
        own = [(d, f) for (d, _, s), f in zip(docs, failed, strict=True) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(here)
                out[part, order, step] = (len(left), len(here), redundant, sum(x[1] == {f} for x in own), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here))
                shapley[part, f] += len(here)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(90):
        words = prose(rng, rng.randint(1, 120))
        words = [rng.choice(words[:5]) if rng.random() < rng.choice([0, 0.9]) else w for w in words]
        words = [w.upper() if i % 7 == 0 else w for w in words] + ["50%"] * (i % 5 == 0)
        rows.append((i, rng.choice([" ", "\n\t"]).join(words), "en", rng.choice(["a", "b", "", None]), 1, "x", 1, 0.5, 1, 7, 3, 2))
    rows += [(100 + i, rows[i][1], *rows[i + 1][2:]) for i in range(20)] + [rows[3], rows[3]]
    rows += [(-1, rows[4][1], *rows[4][2:]), (None, rows[5][1], *rows[5][2:]), (200, None, *rows[0][2:]), (201, "", *rows[1][2:]), (None, None, *rows[1][2:]), (7, "another text of 7", *rows[2][2:])]
    labels = [(rng.randrange(110), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    known = spark.createDataFrame([(*x, "a", 5) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    found = filter_audit.audit(docs, known)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit([(r[0], r[1], r[3]) for r in rows], labels)


def test_filter_audit_of_nothing(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels).where("good_lost + toxic_lost > 0").count() == 0


# SimHash


def brute_print(text, k=3):
    w = re.findall(WORD, lowered(text))
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, radius):
    """nodes: (doc_id, print) of each row."""
    at = {x: x for x in set(nodes)}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    known = sorted(x for x in at if x[0] is not None)
    for a, b in itertools.combinations(known, 2):
        if a[0] == b[0] or (a[1] ^ b[1]).bit_count() <= radius:
            at[find(a)] = find(b)
    least = defaultdict(list)
    for x in known:
        least[find(x)].append(x[0])
    return Counter((d, f"{p:016x}", min(least[find((d, p))]) if d is not None else None) for d, p in nodes)


@pytest.mark.parametrize("radius,blocks,limit", [(3, None, 8192), (3, 5, 2), (12, 13, 1), (0, 1, 3)])
def test_simhash_trees(spark, radius, blocks, limit):
    docs = documents(spark, seed=radius, n=50)
    docs = docs.unionAll(docs.where("doc_id IN (7, 8)")).unionAll(docs.where("doc_id = 9").selectExpr("12L AS doc_id", *docs.columns[1:])).repartition(3)
    nodes = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    got = Counter(tuple(r) for r in simhash_trees.dedup(docs, 3, radius, blocks, limit).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute_components(nodes, radius)


def test_links_connect_chains_and_groups(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):  # groups, in which each is some bits from another
        base = [rng.getrandbits(64)]
        for _ in range(rng.randint(1, 30)):
            x = rng.choice(base)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            base.append(x)
        prints |= set(base)
    nodes = list(enumerate(sorted(prints)))
    rng.shuffle(nodes)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in nodes], "print long, node long").repartition(4)
    for blocks, limit in ((4, 8192), (5, 2), (6, 16)):
        links = [tuple(r) for r in simhash_trees.links(table, 3, blocks, limit).collect()]
        by = dict(nodes)
        assert all(0 < (by[a] ^ by[b]).bit_count() <= 3 for a, b in links)
        parent = {i: i for i, _ in nodes}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        least = {}
        for i in sorted(parent):
            least.setdefault(find(i), i)
        want = brute_components(nodes, 3)
        assert Counter((i, f"{p:016x}", least[find(i)]) for i, p in nodes) == want


def test_fingerprints_are_the_same_in_any_blocks():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 200):
        text = rng.choice([" ", "\n "]).join(prose(rng, n)) + "  É "
        assert {simhash_trees.fingerprint(text, 3, block) for block in (1, 7, 50, 1 << 20)} == {brute_print(text)}
    assert simhash_trees.fingerprint(None) == simhash_trees.fingerprint(" \t") == 0


def test_a_tree_finds_what_is_near():
    rng = random.Random(3)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash_trees.Tree()
    for v in values:
        assert tree.values[tree.add(v)] == v
    assert len(tree.values) == len(set(values))
    for v in range(0, 1024, 7):
        assert sorted(tree.values[i] for i in tree.near(v, 2)) == sorted(x for x in set(values) if (x ^ v).bit_count() <= 2)


def test_shards_of_near_fingerprints_meet():
    rng = random.Random(1)
    for radius, blocks in ((3, 4), (3, 5), (3, 8), (0, 1), (5, 7)):
        masks = simhash_trees.shard_masks(blocks, radius)
        for _ in range(200):
            a = b = rng.getrandbits(64)
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    assert [simhash_trees.blocks_for(n, 3) for n in (0, 10**6, 10**8, 10**11)] == [4, 4, 5, 6]


def test_simhash_trees_of_nothing(spark):
    assert simhash_trees.dedup(documents(spark).limit(0)).count() == 0
    empty = spark.createDataFrame([(3, None), (2, " "), (None, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash_trees.dedup(empty).collect()) == [(0, "0" * 16, None), (2, "0" * 16, 2), (3, "0" * 16, 2)]
