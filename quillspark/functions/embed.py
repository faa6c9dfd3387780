"""Deterministic hashing embedder, in the place of a model: signed feature hashing of search tokens,
unit length. A model is another pandas UDF of the same shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


#: Words whose hashes a model remembers.
KNOWN = 50_000


def hashing_model(dim: int = 64):
    """A function from lists of tokens to vectors."""
    import zlib

    known: dict[str, tuple[int, float]] = {}

    def model(texts) -> list[np.ndarray]:
        out = []
        for words in texts:
            v = np.zeros(dim)
            for w in () if words is None else words:
                if w not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    h = zlib.crc32(w.encode())
                    known[w] = h % dim, 1.0 if h >> 31 else -1.0
                k, s = known[w]
                v[k] += s
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return out

    return model


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = hashing_model(dim)
        for batch in batches:
            yield pd.Series(model(None if t is None else t.split(" ") if t else [] for t in batch))

    # tokens hold no blanks; as one string a text's words are objects only while it is embedded
    return embed(F.array_join(tokens(text), " "))
