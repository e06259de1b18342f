import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.llm import packing, token_stream
from codeweave.llm import tokens as T

from .helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = st.lists(st.sampled_from([*"ab 'sé1\n\t \x1c!.,<|>", "日", "😀", "it's", "<|endoftext|>", " word"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=8))
def test_encoder_equals_the_library(texts):
    enc = T.encoder(PATH)
    for got, text in zip(enc.encode(texts), texts, strict=True):
        assert got.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_texts_of_many_scripts():
    enc = T.encoder(PATH)
    own = ["Привет, мир! Ёлка\nи ещё", "日本語 の テキスト です。", "مرحبا بالعالم كيف", "नमस्ते दुनिया", "👩‍👩‍👧 family e\u0301 café naïve", "한국어 문장 입니다", "Ελληνικά, κείμενο; ναι", "a\u00a0b c\u3000d", "x\u2028y z", "שלום עולם", "tab\there two  spaces", "don't we'll it's"]
    texts = [" ".join(own[i:] + own[:i]) for i in range(len(own))] + own + [t * 3 for t in own]
    for got, text in zip(enc.encode(texts), texts, strict=True):
        assert got.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_goes_whole_where_chunks_do_not_come_apart():
    enc = T.Encoder(PATH)
    enc.opens[:] = False  # as if the library joined all chunks
    assert enc.encode(["one two three", None, ""])[0].tolist() == enc.tokenizer.encode("one two three", add_special_tokens=False).ids
    assert not enc.splits


def test_encoder_keeps_its_table_bounded(monkeypatch):
    monkeypatch.setattr(T, "TABLE_CHUNKS", 50)
    enc = T.Encoder(PATH)
    texts = [f"word{i} other{i * 7} again{i % 3}" for i in range(300)]
    for at in range(0, 300, 20):
        for got, text in zip(enc.encode(texts[at : at + 20]), texts[at : at + 20], strict=True):
            assert got.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.table) < 150


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(0, 3))
def test_blocks_round_trip(ids, seed):
    ids = np.array(ids, np.uint32)
    coder = token_stream.Coder(token_stream.scale(np.bincount(np.append(ids, 301), minlength=400)))
    data = coder.encode(ids)
    back, end = coder.decode(memoryview(data), 0)
    assert back.tolist() == ids.tolist() and end == len(data)


def test_checkpoints_decode_alone_and_damage_shows():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.4, token_stream.BLOCK) % 5000).astype(np.uint32)
    coder = token_stream.Coder(token_stream.scale(np.bincount(ids, minlength=5000)))
    data = coder.encode(ids)
    assert len(data) < ids.nbytes / 2
    step = token_stream.SPAN * token_stream.LANES
    for mark in range(token_stream.BLOCK // step):
        part, _ = coder.decode(memoryview(data), 0, mark, 1)
        assert part.tolist() == ids[mark * step : (mark + 1) * step].tolist()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(memoryview(bytes(broken)), 0)


def test_scale_keeps_every_symbol():
    freq = token_stream.scale(np.array([10**9, 1, 0, 1, 3]))
    assert freq.sum() == 1 << token_stream.BITS and freq[2] == 0 and (freq[[0, 1, 3, 4]] > 0).all()
    assert token_stream.scale(np.zeros(4, np.int64)).sum() == 0


def expected(docs, end_id):
    enc = T.encoder(PATH)
    return [(d, np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")) for d, t in docs]


def test_stream_of_documents(spark):
    docs = documents(spark)
    got = [tuple(r) for r in token_stream.stream(docs, PATH, 2, file_ids=400).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want, at = [], 0
    pairs = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, ids in expected(pairs, 2):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_stream.stream(docs.limit(0), PATH).count() == 0


def test_stream_of_rows_that_share_an_id(spark):
    rows = [(None if i % 3 == 0 else i % 4, " ".join(["word"] * (i % 7)) + f" {i}") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    runs = [sorted(tuple(r) for r in token_stream.stream(docs.repartition(n), PATH, 2, file_ids=60).select("start", "doc_id", "n_tokens", "ids_crc32").collect()) for n in (1, 9)]
    assert runs[0] == runs[1]
    at = 0
    for start, _, n, _ in runs[0]:
        assert start == at
        at += n
    ids = [r[1] for r in runs[0]]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == 65


def test_packing_of_documents(spark):
    docs = documents(spark)
    docs = docs.unionAll(docs.where("doc_id = 9"))  # a repeated row
    for window in (64, 2048):
        got = packing.pack(docs, PATH, 1, window).collect()
        pieces: dict = {}
        for r in got:
            pieces.setdefault(r["doc_id"], []).append(r)
        texts = {d: ids for d, ids in expected(docs.select("doc_id", "text").collect(), 1)}
        for d, own in pieces.items():
            ids, copies = texts[d], 2 if d == 9 else 1
            assert sum(r["length"] for r in own) == len(ids) * copies
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        windows: dict = {}
        for r in got:
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        fills = []
        for own in windows.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= window
            fills.append(at)
        assert sum(f < window for f in fills) <= 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_plan_covers_each_length_once():
    rng = np.random.default_rng(5)
    h = rng.poisson(20, 256)
    h[0] = 0
    slots, used = packing.plan(h, 256)
    assert (used <= h).all() and used.sum() > 0.9 * h.sum()
    for length in range(256):
        own = sorted(s[1:3] for s in slots if s[0] == length)
        assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and (not own or (own[0][0], own[-1][1]) == (0, used[length]))
    x = packing.solve([{1: 1, 3: 1}, {2: 2}], np.array([0, 5, 8, 5]))
    assert np.allclose(x, [5, 4], atol=0.2)
