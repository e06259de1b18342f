"""Embedding of texts: an interface, and a backend that needs no model.

An embedder is anything with `dims` and `embed(texts, input_type) -> array`. The default hashes words and parts of words into
a vector of unit length; others plug in by `register`. Backends are named on the driver and made once in each worker.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .. import schema
from .text import node_text, should_embed

#: Texts in a call, by backend (fixed values).
BATCHES = {"hosted": 100, "local": 32}


class Embedder(Protocol):
    dims: int
    batch: int

    def embed(self, texts: list[str], input_type: str = "document") -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words, their camel-case parts and trigrams; unit length, zero for a text without any."""

    def __init__(self, dims: int = 256) -> None:
        self.dims, self.batch = dims, BATCHES["local"]

    def _features(self, text: str) -> list[str]:
        words = re.findall(r"\w+", text)
        parts = [p.lower() for w in words for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", w)]
        return [w.lower() for w in words] + parts + [f"#{p[i : i + 3]}" for p in parts for i in range(len(p) - 2)]

    def embed(self, texts: list[str], input_type: str = "document") -> np.ndarray:
        """Features of all texts are counted at once: each distinct one is hashed once, by CRC-32."""
        found = [self._features(t or "") for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        numbers: dict[str, int] = {}
        own = np.array([numbers.setdefault(f, len(numbers)) for each in found for f in each], np.int64)
        hashes = np.array([zlib.crc32(f.encode()) for f in numbers], np.int64)
        out = np.zeros((len(texts), self.dims), np.float32)
        if len(own):
            h = hashes[own]
            np.add.at(out, (rows, h % self.dims), np.where(h >> 31, 1, -1).astype(np.float32))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


class HostedEmbedder:
    """A remote service, given as a function of a list of texts to (index, vector) pairs; refuses to start without one."""

    def __init__(self, call: Callable[[list[str]], list[tuple[int, list[float]]]] | None = None, dims: int = 1536) -> None:
        if call is None:
            raise ValueError("a hosted embedder needs a function that calls it")
        self.call, self.dims, self.batch = call, dims, BATCHES["hosted"]

    def embed(self, texts: list[str], input_type: str = "document") -> np.ndarray:
        return np.array([v for _, v in sorted(self.call(texts), key=lambda p: p[0])], np.float32).reshape(len(texts), self.dims)


#: `local` names what runs without a service: hashing, as there is no model here.
_BACKENDS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder, "local": HashingEmbedder, "hosted": HostedEmbedder}


def register(name: str, make: Callable[[], Embedder]) -> None:
    _BACKENDS[name] = make


@lru_cache(maxsize=4)
def _made(make: Callable[[], Embedder]) -> Embedder:
    return make()


def chosen() -> str:
    """The backend that the environment names; hashing where it names none."""
    return os.environ.get("EMBEDDER", "hashing")


def _backend(name: str | None) -> Callable[[], Embedder]:
    name = name or chosen()
    if name not in _BACKENDS:
        raise ValueError(f"no such embedder: {name}; there are {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name]


def dimensions(backend: str | None = None) -> int:
    return _made(_backend(backend)).dims


def embed_column(text: Column, backend: str | None = None, input_type: str = "document") -> Column:
    make = _backend(backend)

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        embedder, out = _made(make), []
        for at in range(0, len(texts), embedder.batch):
            out.extend(embedder.embed(texts.iloc[at : at + embedder.batch].fillna("").tolist(), input_type))
        return pd.Series(out, index=texts.index)

    return run(text)


def embed_query(text: str, backend: str | None = None) -> list[float]:
    return _made(_backend(backend)).embed([text], "query")[0].tolist()


def embed_nodes(nodes: DataFrame, level: str = "high", backend: str | None = None) -> DataFrame:
    """(id, embedding) of the nodes that a level embeds; data containers get none."""
    kinds = schema.LEVEL_EMBEDS[level]
    rows = nodes.where(F.col("type").isin(kinds) if kinds else F.lit(False)).where(should_embed(F.col("type"), F.col("file_path")))
    text = node_text(F.col("type"), F.col("name"), F.col("file_path"), F.col("first_line"), F.col("source_code"))
    return rows.select("id", embed_column(text, backend).alias("embedding"))
