"""Embedders: batches of texts to unit vectors (S23, X2). The stub is deterministic and needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stub(texts: list[str], dim: int = 64) -> np.ndarray:
    """Standard normal vectors seeded by the first eight bytes of the text's SHA-256, of unit length, as float32."""
    out = np.empty((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
        v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
        out[i] = v / np.linalg.norm(v)
    return out


def embedder(kind: str, **options) -> Callable[[list[str]], np.ndarray]:
    if kind == "stub":
        return lambda texts: stub(texts, int(options.get("dim", 64)))
    raise ValueError(f"no embedder of kind {kind!r}: only the local stub is built in, cloud services are refused")


def embed(df: DataFrame, text: str, kind: str = "stub", column: str = "embedding", **options) -> DataFrame:
    """Add a unit vector of ``text``; null texts embed as empty ones."""
    model = embedder(kind, **options)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())))

    return df.withColumn(column, run(text))
