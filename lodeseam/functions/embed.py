"""Embedders: what turns text into vectors, by name."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

TOKEN = re.compile("[a-z0-9]+")


@lru_cache(1 << 17)
def cell(token: str, dimensions: int) -> tuple[int, int]:
    """Cell and sign of a token; the same as functions.text.bucket and sign."""
    h = hashlib.sha1(token.encode()).digest()  # noqa: S324 - a fixed hash, not a secret
    return int.from_bytes(h[:4], "big") % dimensions, 1 if h[4] % 2 == 0 else -1


def cells(words: Counter, dimensions: int) -> np.ndarray:
    """Signed counts of the tokens by cell."""
    out = np.zeros(dimensions, np.int64)
    for w, n in words.items():
        i, s = cell(w, dimensions)
        out[i] += s * n
    return out


class Embedder(Protocol):
    dimensions: int

    def column(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Signed token counts in hashed cells, at unit length; texts without tokens are all zero, null texts null."""

    def __init__(self, dimensions: int = 256):
        if dimensions < 1:
            raise ValueError("dimensions must be above 0")
        self.dimensions = dimensions

    def embed(self, text: str) -> np.ndarray:
        x = cells(Counter(TOKEN.findall(text.lower())), self.dimensions).astype(float)
        norm = np.linalg.norm(x)
        return (x / norm if norm else x).astype(np.float32)

    def column(self, text: Column) -> Column:
        embed = self.embed

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([embed(t).tolist() if isinstance(t, str) else None for t in texts], dtype=object)

        return F.pandas_udf(run, ArrayType(FloatType(), False))(text)


_known: dict[str, Callable[[int], Embedder]] = {"hashing": HashingEmbedder}


def register(name: str, make: Callable[[int], Embedder]) -> None:
    """Makes an embedder available by name; make takes the dimensions."""
    _known[name] = make


def embedder(name: str = "hashing", dimensions: int = 256) -> Embedder:
    """The embedder of that name; unknown names mean hashing."""
    return _known.get(name, HashingEmbedder)(dimensions)
