"""Joins, repeats and archives against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeweave.llm import chunks, jaccard_join, legacy_archive, repeats, words

from .helpers import documents, prose

WORD = r"[^\x20\x09-\x0D]+"


def sets_of(pairs, k):
    out = []
    for _, t in pairs:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def components(pairs, k, percent):
    """(doc_id, set size, component) of each row; rows of one doc_id are one document, null doc_ids are alone."""
    sets = sets_of(pairs, k)
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            named = pairs[i][0] is not None and pairs[j][0] is not None
            if named and (pairs[i][0] == pairs[j][0] or (both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both))):
                label[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(pairs))


def joined(docs, *args, **more):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, *args, **more).collect())


@pytest.mark.parametrize("k,percent,frequent,wide", [(4, 85, 64, 48), (2, 60, 3, 30), (2, 60, 3, 2)])
def test_jaccard_join(spark, k, percent, frequent, wide):
    docs = documents(spark, seed=k + wide)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs, k, percent, frequent, wide) == components(pairs, k, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_rows_that_share_ids(spark, seed):
    rng = random.Random(seed)
    a, b, c, d = (" ".join(prose(rng, 40)) for _ in range(4))
    pairs = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, None), (5, c), (None, a), (None, a), (None, d), (6, ""), (6, d), (7, d + " x"), (8, "one"), (8, "two"), (9, "two"), (5, "  ")]
    pairs += [(rng.randint(20, 30), " ".join(prose(rng, 12) * rng.randint(1, 2))) for _ in range(20)] + [(rng.randint(20, 30), rng.choice([a, b, c, d, None, "", "two"])) for _ in range(6)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = joined(docs, 3, 80)
    assert got == components(pairs, 3, 80)
    kept = jaccard_join.kept_of(docs, 3, 80).collect()
    own = {d: x for d, _, x in got}
    assert Counter((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None) == Counter({(d, t) for d, t in pairs if d is not None and own[d] == d})
    assert sum(r["doc_id"] is None for r in kept) == 3


@pytest.mark.parametrize("per_class", [2, 12, 1000])
def test_jaccard_join_of_texts_with_hundreds_of_frequent_tokens(spark, per_class):
    rng = random.Random(per_class)
    passages = [prose(rng, 60) for _ in range(12)]
    pairs = []
    for i in range(60):  # whole texts of passages that others have, too, some with an edit
        text = [w for p in rng.sample(passages[: 4 + i % 9], 4) for w in p]
        pairs.append((i, " ".join(text)))
        if i % 2:
            text = list(text)
            for _ in range(rng.randint(1, 9)):
                text[rng.randrange(len(text))] = f"new{i}"
            pairs.append((100 + i, " ".join(text)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    assert joined(docs, 3, 80, 3, per_class, few=10**9, bundle=2) == components(pairs, 3, 80)


def test_classes_of_sets_that_link_meet():
    for percent in (51, 60, 85, 100):
        for n in (*range(2, 300), 5000, 100_000):
            for m in {n, -(-percent * n // 100)}:
                assert dict(jaccard_join.classes_of(n, percent)).keys() & dict(jaccard_join.classes_of(m, percent)).keys()
    rng = np.random.default_rng(1)
    tokens = words.mix(np.arange(20_000, dtype=np.uint64))
    assert len(jaccard_join.entries(tokens, np.full(len(tokens), 20, np.uint8), 85)) < 60 * 3000
    for _ in range(40):  # two sets at the threshold always share an entry
        n = int(rng.integers(20, 3000))
        own = rng.permutation(tokens)[: n + n // 10]
        a, b = own[:n], np.concatenate([own[: n - int(0.08 * n)], own[n:][: int(0.08 * n)]])
        cls = dict(zip(own.tolist(), rng.integers(0, 20, len(own)).astype(np.uint8).tolist(), strict=True))
        cls |= {x: max(1, cls[x]) for x in (set(a.tolist()) & set(b.tolist()))}
        keys = [set(jaccard_join.entries(x, np.array([cls[t] for t in x.tolist()], np.uint8), 85).tolist()) for x in (a, b)]
        assert keys[0] & keys[1] or not jaccard_join.similar(a, b, 85)


def test_jaccard_join_of_chains_and_of_nothing(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):  # each text differs a little from the one before
        base = list(base)
        base[4 * i + 2] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, 1, 90).collect()}
    assert set(got.values()) == {89}
    assert {r["doc_id"] for r in jaccard_join.kept_of(docs, 1, 90).collect()} == {89}
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_kept_of_keeps_one_of_each_group(spark):
    docs = documents(spark)
    docs = docs.unionAll(docs.where("doc_id = 8"))
    kept = jaccard_join.kept_of(docs)
    want = components([tuple(r) for r in docs.select("doc_id", "text").distinct().collect()], 5, 80)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _, c in want if d is None or c in (None, d))


def brute_repeats(pairs, k):
    occurrences, own = {}, [re.findall(WORD, t or "") for _, t in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is not None, pairs[i][0] or 0, i))
    for i in order:
        for j in range(len(own[i]) - k + 1):
            occurrences.setdefault(tuple(own[i][j : j + k]), (i, j))
    out = {}
    for i, w in enumerate(own):
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if occurrences[tuple(w[j : j + k])] != (i, j):
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[pairs[i][0]] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,base", [(20, 5), (7, 2), (3, 5)])
def test_repeats(spark, window, base):
    docs = documents(spark, seed=window)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repeats.dedup(docs, window, base).drop("kept").collect()}
    assert got == brute_repeats(pairs, window)


def test_a_text_of_several_blocks(spark):
    rng = random.Random(5)
    own = ["".join(rng.choice("abcdefgh") for _ in range(18)) for _ in range(480_000)]
    own[300_000:300_040] = own[1000:1040]
    text = " ".join(own)
    assert len(text) > 2 * words.BLOCK
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, " ".join(own[470_000:]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeats.dedup(docs, 20).drop("kept").collect()}
    assert got == {1: (480_000, 40), 2: (480_001, 480_000), 3: (10_000, 10_000)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_repeats_by_an_exchange_in_two_steps(spark):
    docs = documents(spark, seed=9).repartition(9)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repeats.dedup(docs, 6, 3, few=10**9, bundle=2).drop("kept").collect()}
    assert got == brute_repeats(pairs, 6)


def test_repeats_within_one_text_and_in_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c a b c a b c"), (2, "x a b c y"), (2, "x a b c y"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in repeats.dedup(docs, 3, 2).collect())
    assert got == [(1, 6, "a b c"), (2, 3, "x y"), (2, 5, ""), (3, 0, "")]
    assert repeats.dedup(docs.limit(0)).count() == 0


def test_repeats_in_chunks_of_a_few_words(spark):
    text = " ".join(f"w{i}" for i in range(25))
    pairs = [(1, "a b c"), (2, "a b c d e f g"), (3, text), (4, f"x {text}"), (5, "")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(pairs, len(pairs)), "doc_id long, text string")  # each alone in a partition
    got = {r[0]: tuple(r)[1:] for r in repeats.dedup(docs, 20).drop("kept").collect()}
    assert got == brute_repeats(pairs, 20)


def test_levels_at_most_double():
    for n in range(1, 70):
        steps = repeats.levels(n, 5)
        assert steps[-1] == n and all(b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_words_and_windows():
    texts = ["Foo  bar\tbaz", "", "é 日本 x", "\n", "a b a b a b"]
    w = words.words([t.encode() for t in texts])
    want = [re.findall(WORD, t) for t in texts]
    assert [w.data[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for t in want for x in t]
    assert np.diff(w.bounds).tolist() == [len(t) for t in want]
    for k in (1, 2, 3, 5):
        keys, first = w.runs(k)
        runs = [(int(w.bounds[d]) + i, tuple(t[i : i + k])) for d, t in enumerate(want) for i in range(len(t) - k + 1)]
        assert first.tolist() == [a for a, _ in runs]
        assert len(set(keys.tolist())) == len({r for _, r in runs})


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert chunks.unpack_keys(memoryview(chunks.pack_keys(keys))).tolist() == keys.tolist()
    assert chunks.unpack_keys(memoryview(chunks.pack_keys(keys[:0]))).tolist() == []
    big = np.array([0, (1 << 64) - 1], np.uint64)
    assert chunks.unpack_keys(memoryview(chunks.pack_keys(big))).tolist() == big.tolist()
    for k, bits in ((keys, 48), (big, 64), (keys >> np.uint64(28), 20), (keys[:0], 48)):
        k = np.unique(k)
        used, begins, ends = chunks.shares(k, 7, bits)
        assert begins.tolist() == [0, *ends.tolist()][: len(begins)] and (len(k) == 0 or ends[-1] == len(k))
        for p, a, b in zip(used.tolist(), begins.tolist(), ends.tolist(), strict=True):
            assert all(int(x) * 7 >> bits in (p, p + 1) for x in k[a:b]) and 0 <= p < 7


# --- archives ---------------------------------------------------------------------------------------------------------


def test_archive_of_pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>" * (i % 4 + 1)) for i in range(12)] + [(20, None, None), (21, "http://h/ x", ""), (None, "http://n", "<p>1</p><p>1</p>"), (None, "http://m", "alone")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, place string, raw string")
    got = {(r["page_id"], r["url"]): r for r in legacy_archive.archive(pages, file_bytes=300).collect()}
    assert len(got) == len(rows)
    by: dict = {}
    for p, _, h in rows:
        by.setdefault((h or "").encode(), []).append(p)
    for p, u, h in rows:
        body = (h or "").encode()
        known = [x for x in by[body] if x is not None]
        r = got[p, (u or f"urn:page:{p}").replace(" ", "%20")]
        first = max(known) if known else None
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first is None or p == first else ("revisit", first))
    assert legacy_archive.archive(pages.limit(0)).count() == 0


def test_archive_of_urls_that_look_like_version_blocks(spark):
    rows = [(1, "filedesc://x", "a"), (2, "filedesc://", "a"), (3, "filedesc://y 1 2 3", ""), (4, "http://h\r\nX: 1", "b")]
    got = {r["page_id"]: r for r in legacy_archive.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), file_bytes=1).collect()}
    assert {p: (r["record_type"], r["refers_to"], r["url"]) for p, r in got.items()} == {1: ("revisit", 2, "filedesc://x"), 2: ("response", None, "filedesc://"), 3: ("response", None, "filedesc://y%201%202%203"), 4: ("response", None, "http://hX:%201")}
    assert got[1]["refers_to_record"] == got[2]["record_id"] and got[1]["payload_bytes"] == 1


def test_arc_versions_and_damage():
    v1 = legacy_archive.arc_version_block("a.arc", 1, "19990101000000") + legacy_archive.arc_record(1, "http://a/b c", "1.2.3.4", "19990102", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi")
    v2 = legacy_archive.arc_version_block("b.arc", 2, "20040101000000") + legacy_archive.arc_record(2, "dns:a", "0.0.0.0", "200401", "text/dns", b"a 1.2.3.4")
    for data, version, url, kind in ((v1, 1, "http://a/b c", "response"), (v2, 2, "dns:a", "resource")):
        head, record = legacy_archive.parse_arc(data)
        assert head.fields["url"].startswith("filedesc://") and record.version == version and record.fields["url"] == url
        ((h, block),) = legacy_archive.parse_warc(legacy_archive.deflate(legacy_archive.convert(record.fields, record.block, "x")))
        assert h["warc-type"] == kind and block == record.block
        ((h, _),) = legacy_archive.parse_warc(legacy_archive.convert(head.fields, head.block, "x"))
        assert h["warc-type"] == "warcinfo"
    with pytest.raises(ValueError, match="declared length"):
        list(legacy_archive.parse_arc(v1[:-5]))
    assert [legacy_archive.iso(d) for d in ("1999", "199902", "19990203", "19990203040506", "junk")] == ["1999-01-01T00:00:00Z", "1999-02-01T00:00:00Z", "1999-02-03T00:00:00Z", "1999-02-03T04:05:06Z", "1970-01-01T00:00:00Z"]


def test_entries_of_the_same_documents_are_compared_once(spark, monkeypatch):
    from codeweave.llm import jaccard_join, shared

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    both, one, two = words("p", 1400), words("q", 600), words("r", 600)
    docs = spark.createDataFrame([(0, f"{both} {one}"), (1, f"{both} {two}"), (2, one), (3, two), (4, f"{one} x")], "doc_id long, text string")
    seen, kept = {}, shared.kept

    def spy(df, name, *more, **named):
        out = kept(df, name, *more, **named)
        if name == "apart":
            seen["entries"] = out.select("sig").distinct().count()
        return out

    monkeypatch.setattr(shared, "kept", spy)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, 5, 80).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    assert 0 < seen["entries"] < 20


def test_a_pair_of_many_entries_is_made_once_and_none_is_lost(spark):
    import random

    from pyspark.sql import functions as F

    from codeweave.llm import jaccard_join as J

    rng, none = random.Random(5), [0] * 8
    docs = {rep: (100 + rep % 3, rep // 2, rng.sample(range(60), 1 if rep % 5 == 0 else 40)) for rep in range(40)}
    rows = [(sig * 7919, rep, n, n, label, *none) for rep, (n, label, sigs) in docs.items() for sig in sigs]
    known = spark.createDataFrame(rows, "sig long, rep long, n int, shared int, label long, " + ", ".join(f"{c} long" for c in J.BITS))
    apart = known.join(known.groupBy("sig").agg(F.count("*").alias("docs")), "sig").withColumn("entry", J.ordered("docs"))
    made = [(r["a"], r["b"]) for r in J.crossed(apart.drop("sig", "docs"), 80).collect()]
    wanted = {(a, b) for a in docs for b in docs if a < b and docs[a][1] != docs[b][1] and set(docs[a][2]) & set(docs[b][2])}
    assert set(made) == wanted
    assert len(made) < 1.5 * len(wanted)
