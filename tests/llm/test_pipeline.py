"""The corpus pipeline, stage by stage, and the registered queries."""

import hashlib
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codeweave.llm import mixing, queries, secrets, tokens, toxicity

from .test_models import brute_secrets, plain_score
from .test_near import WORD, components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_thirteen_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.shared.kept(stage(spark, docs, SF), "test")
        assert docs.schema.names == before.schema.names
        counts.append(docs.count())
        if name == "toxicity":
            left = {r[0] for r in docs.select("doc_id").collect()}
            assert len(left & toxic) < len(toxic) / 2
        if name == "secrets":
            assert counts[-1] == counts[-2]
            assert docs.where("text rlike 'AKIA[A-Z0-9]{14}' OR n_chars <> length(text)").count() == 0
    assert counts[0] > counts[1] > counts[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.selectExpr("sum(length)").first()[0] > 0
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_pipeline_of_nothing_and_of_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clash = docs.withColumns({c: F.lit("kept") for c in ("n_tokens", "take_tokens", "mix_lang", "found", "base", "component_id", "score", "start", "_key", "cap")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, SF)
        assert after.columns == clash.columns and {tuple(r) for r in after.select("n_tokens", "base", "score", "_key").distinct().collect()} == {("kept",) * 4}
    none = spark.createDataFrame([(None, None, None, None, None), (5, None, None, "s", None), (6, "", "en", None, 0), (7, "a few plain words", "en", "s", 17)], docs.schema)
    for i, rows in enumerate((docs.limit(0), none)):
        rows.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{i}").collect()} <= {7}


def fill(budget, children):
    """Water-filling by trying: children (name: cap, weight) get their shares."""
    share, free = {}, dict(children)
    while True:  # who takes less than its part is full; the rest is dealt anew
        whole = sum(w for _, w in free.values())
        full = {n for n, (cap, w) in free.items() if cap * whole <= w * budget}
        if not full:
            break
        for n in full:
            share[n] = free.pop(n)[0]
            budget -= share[n]
        if not free:
            return share
    share |= {n: w * budget // whole for n, (_, w) in free.items()}
    left = budget - sum(share[n] for n in free)
    for n in sorted(n for n in free if share[n] < free[n][0])[:left]:
        share[n] += 1
    return share


def brute_mix(docs, budget, epochs, seed):
    """(row, words taken) of each row chosen, by leaf and by pass."""
    leaves: dict = {}
    for d in docs:
        n = len(re.findall(WORD, d["text"] or ""))
        if n:
            name = d["source"] or ""
            leaves.setdefault((f"group{(ord(name[-1]) if name else 0) % 4}", d["lang"] or "", name), []).append((d, n))
    caps = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    weights = [mixing.WEIGHTS["domain"], mixing.WEIGHTS["lang"], {}]
    level = {(): min(int(budget * (sum(caps.values()) // epochs)), sum(caps.values()))}
    for i in range(3):
        nxt = {}
        for parent, own in level.items():
            children: dict = {}
            for k, cap in caps.items():
                if k[:i] == parent:
                    children[k[i]] = (children.get(k[i], (0, 0))[0] + cap, weights[i].get(k[i], 1))
            nxt |= {(*parent, c): s for c, s in fill(own, children).items()}
        level = nxt
    out = []
    for leaf, share in level.items():
        epoch = 0
        while share > 0:
            for d, n in sorted(leaves[leaf], key=lambda p: (hashlib.md5(f"{seed}|{epoch}|{p[0]['doc_id']}".encode()).hexdigest(), hashlib.md5(p[0]["text"].encode()).hexdigest())):
                if share > 0:
                    out.append((d, min(n, share)))
                    share -= n
            epoch += 1
    return out


def test_pipeline_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    rows = [d.asDict() for d in docs.collect()]
    rows = [d for d in rows if plain_score(lexicon, d["text"]) < corpus_pipeline.THRESHOLD]
    kept = {doc: least for doc, _, least in components([(d["doc_id"], d["text"]) for d in rows], corpus_pipeline.WORDS, corpus_pipeline.PERCENT)}
    rows = [d for d in rows if kept[d["doc_id"]] == d["doc_id"]]
    left = spark.createDataFrame(rows, docs.schema)
    table, k = secrets.fit(left), len(secrets.ALPHABET) + 1
    for d in rows:
        spans = [(a, b) for a, _, b in brute_secrets(d["text"])]
        for m in re.finditer(secrets.CANDIDATE, d["text"]):
            codes = [secrets.ALPHABET.find(c) + 1 for c in m[0]]
            r = sum(float(f"{table[a * k + b]:.4f}") for a, b in zip(codes, codes[1:], strict=False))
            if r >= secrets.TOTAL and r >= secrets.PER_CHAR * (len(codes) - 1) and not any(a < m.end() and b > m.start() for a, b in spans):
                spans.append(m.span())
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += d["text"][at:a] + "[SECRET]"
            at = max(at, b)
        d["text"] = out + d["text"][at:]
    encoder, want = tokens.encoder(queries.vocabulary()), []
    for d, take in brute_mix(rows, corpus_pipeline.BUDGET, corpus_pipeline.EPOCHS, corpus_pipeline.SEED):
        have = [m.end() for m in re.finditer(WORD, d["text"])]
        text = d["text"][: have[take - 1]] if take < len(have) else d["text"]
        want.append((d["doc_id"], np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4")))
    pieces = corpus_pipeline.run(spark, SF).collect()
    # Each token of each row lies in one piece, and a piece holds the tokens of a row of its document.
    known: dict = {}
    for doc, ids in want:
        known.setdefault((doc, len(ids)), []).append(ids)
    assert sum(r["length"] for r in pieces) == sum(len(ids) for _, ids in want)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == Counter((doc, len(ids)) for doc, ids in want)
    for r in pieces:
        assert r["ids_crc32"] in {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in known[r["doc_id"], r["doc_tokens"]]}
    windows: dict = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.WINDOW
    assert sum(sum(n for _, n in own) < corpus_pipeline.WINDOW for own in windows.values()) <= 1
