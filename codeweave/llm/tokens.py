"""Token ids of whole texts, by the tokenizers library.

`Encoder.encode(texts)` gives exactly what `Tokenizer.encode(text, add_special_tokens=False)` gives, text by text.
A byte-level BPE never merges across the start of a white-space run, so a text is cut before each single space and
every distinct chunk goes through the library once; repeats come from a table, which is an Arrow array, so that no
string of a repeat becomes a Python object. Texts for which that cut is not provably safe (runs of white space, other
white space than space and newline, strings of added tokens) go through the library whole, and so do all texts where
the library turns out not to keep chunks apart.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that the table holds; beyond them it goes back to the first quarter, which came first as it comes often.
TABLE_CHUNKS = 700_000
#: Mean length of a text's chunks, in characters, beyond which it goes through whole: it would fill the table for nothing.
TABLE_CHARS = 64
#: Text that is cut and looked up at once, in bytes.
GATHER_BYTES = 4 << 20
#: Chunks whose ids are put together at once.
ASSEMBLE = 1 << 18

_LINE, _NONE = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
_ODD = re.compile(r"[^\S\n ]|[\x1c-\x1f]")


def gathered(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `size` bytes of a column: the table is asked once for each."""
    own: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        own.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield pa.concat_batches(own)
            own, held = [], 0
    if own:
        yield pa.concat_batches(own)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Chunks must come apart where an id begins with a space or is the newline; else every text goes through whole.
        kind, probe = self.tokenizer.pre_tokenizer.__class__.__name__, self._library(["a", " b", "a\nb a"])
        self.newline = probe[2][len(probe[0])]
        self.opens = np.zeros(self.vocabulary, bool)
        self.opens[[n for t, n in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.startswith("\u0120")] + [self.newline]] = True
        self.splits = kind == "ByteLevel" and self.tokenizer.normalizer is None and probe[2][: len(probe[0]) + 1] == probe[0] + [self.newline]
        self.table = pa.array(["\n"], pa.large_string())
        self.flat = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int64)
        self.flat[0], self.lens[0], self.n_flat = self.newline, 1, 1

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> bool:
        """Puts chunks in the table, with their ids: as one text, cut where an id opens a chunk.

        A chunk that begins a line keeps the newline's id in front; the others begin with a space. False, with the
        table as it was, where ids do not come apart like the chunks.
        """
        n_known, n_flat = len(self.table), self.n_flat
        for at in range(0, len(new), 1 << 15):
            part = new.slice(at, 1 << 15).to_numpy(zero_copy_only=False).tolist()
            glued = [c if c[:1] == "\n" else " " + c for c in part]
            got = self._library(["".join(glued[i : i + 512]) for i in range(0, len(glued), 512)])
            ids = np.concatenate([np.asarray(g, np.uint32) for g in got])
            breaks = np.flatnonzero(self.opens[ids])
            if len(breaks) != len(part):
                self.n_flat = n_flat
                return False
            while self.n_flat + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n_known + len(part) > len(self.lens):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
            self.flat[self.n_flat : self.n_flat + len(ids)] = ids
            self.starts[n_known : n_known + len(part)] = self.n_flat + breaks
            self.lens[n_known : n_known + len(part)] = np.diff(breaks, append=len(ids))
            self.n_flat += len(ids)
            n_known += len(part)
        self.table = pa.concat_arrays([self.table, new])
        return True

    def _numbers(self, chunks: pa.Array) -> np.ndarray | None:
        """The place of each chunk in the table, which learns those that are new; None where it cannot."""
        coded = pc.dictionary_encode(chunks)
        at = pc.index_in(coded.dictionary, value_set=self.table)
        new = coded.dictionary.filter(at.is_null())
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            first = len(self.table)
            if not self._learn(new):
                return None
            places[places < 0] = np.arange(first, first + len(new))
        return places[coded.indices.to_numpy()]

    def safe(self, text: str) -> bool:
        """Whether the text may be cut before each space and newline."""
        if not self.splits or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text:
            return False
        if len(text) > TABLE_CHARS * (text.count(" ") + text.count("\n") + 1):
            return False
        if not text.replace("\n", "").isprintable() and _ODD.search(text):
            return False
        return not any(a in text for a in self.added)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null and empty texts."""
        if len(self.table) > TABLE_CHUNKS:
            self.table = self.table.slice(0, TABLE_CHUNKS // 4)
            self.n_flat = int(self.starts[len(self.table) - 1] + self.lens[len(self.table) - 1])
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out: list[np.ndarray | None] = [None] * len(column)
        whole: list[int] = []
        cut: list[int] = []
        plain = column.to_numpy(zero_copy_only=False)
        for i, text in enumerate(plain):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            else:
                (cut if self.safe(text) else whole).append(i)
        del plain
        if cut:
            own = column if len(cut) == len(column) else column.take(pa.array(cut, pa.int64()))
            # As if at the start of a line; the newline's id is taken off below.
            lists = pc.split_pattern(pc.binary_join_element_wise(_LINE, pc.replace_substring(own, "\n", " \n"), _NONE), " ")
            numbers = self._numbers(lists.flatten())
            if numbers is None:
                self.splits = False
                whole = sorted(whole + cut)
            else:
                self._assemble(numbers, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), cut, out)
        for at in range(0, len(whole), 64):
            part = whole[at : at + 64]
            for i, ids in zip(part, self._library([column[i].as_py() for i in part]), strict=True):
                out[i] = np.asarray(ids, np.uint32)
        return out  # type: ignore[return-value]

    def _assemble(self, numbers: np.ndarray, bounds: np.ndarray, texts: list[int], out: list[np.ndarray | None]) -> None:
        """The ids of texts whose chunks lie between bounds."""
        lens = self.lens[numbers]
        ends = np.cumsum(lens)
        ids = np.empty(int(ends[-1]), np.uint32)
        for a in range(0, len(numbers), ASSEMBLE):
            b = min(len(numbers), a + ASSEMBLE)
            low = int(ends[a] - lens[a])
            shift = np.repeat(self.starts[numbers[a:b]] - (ends[a:b] - lens[a:b]), lens[a:b])
            ids[low : int(ends[b - 1])] = self.flat[np.arange(low, int(ends[b - 1])) + shift]
        at = np.concatenate([[0], ends])[bounds]
        for k, i in enumerate(texts):
            out[i] = ids[at[k] + 1 : at[k + 1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
