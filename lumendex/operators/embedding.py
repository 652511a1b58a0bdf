"""Embedding: a provider protocol, a deterministic default and the Arrow-batched column function."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 384
_TOKEN = re.compile(r"\w+|[^\w\s]")


class Embedder(Protocol):
    model_name: str
    dimension: int

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        """One row of float32 a text."""


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens (batch x tokens x dims), scaled to length one."""
    m = mask.astype(np.float64)[:, :, None]
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return (mean / np.where(norm == 0, 1, norm)).astype(np.float32)


class HashingEmbedder:
    """Signed feature hashing of tokens, pooled and normalised: deterministic, no model needed."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self.model_name = f"hashing-{dimension}"

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        # Sums are kept instead of a row a token, so a long text costs no more than a short one.
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            h = np.array([zlib.crc32(x.encode()) for x in _TOKEN.findall(t.lower()) or ["\0"]], np.int64)
            np.add.at(out[i], (h >> 1) % self.dimension, np.where(h & 1, 1.0, -1.0) / len(h))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = (out / np.where(norm == 0, 1, norm)).astype(np.float32)
        out[~out.any(axis=1), 0] = 1  # tokens that cancel out
        return out


def embed_column(embedder: Embedder, text: Column, batch: int = 32) -> Column:
    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = []
            for i in range(0, len(s), batch):
                v = embedder.embed_batch(list(s.iloc[i : i + batch]))
                if v.shape[1] != embedder.dimension:
                    raise ValueError(f"the model gave {v.shape[1]} dimensions instead of {embedder.dimension}")
                rows += list(v)
            yield pd.Series(rows, index=s.index)

    return embed(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunk_hash, embedding of distinct chunks."""
    return chunks.select("chunk_hash", embed_column(embedder, F.col("content")).alias("embedding"))
