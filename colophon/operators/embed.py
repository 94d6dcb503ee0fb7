"""Embedding hooks (R7, R8, R47, S27): a model is plugged in; the default hashes words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.functions.text import clean_query

DIMENSION = 256


def hashed_words(texts: list[str], dim: int = DIMENSION) -> list[list[float]]:
    """Unit vectors of signed hashed word counts: the same everywhere, without a model."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for w in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if (h >> 31) & 1 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1.0)).tolist()


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, batch: int = 32, prefix: str = ""):
    """A column function text -> ARRAY<FLOAT>; ``load`` runs once per worker, the model sees ``batch`` texts at a time."""

    @F.pandas_udf(returnType=T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else hashed_words
        for part in parts:
            texts = [prefix + (t or "") for t in part]
            vectors: list = []
            for i in range(0, len(texts), batch):
                vectors += model(texts[i : i + batch])
            yield pd.Series(vectors)

    return embed


def embed_queries(queries: DataFrame, embed=None) -> DataFrame:
    """``query_id, vector`` of cleaned queries; equal queries are embedded once."""
    cleaned = queries.select("query_id", clean_query(F.col("query")).alias("q"))
    vectors = cleaned.select("q").distinct().withColumn("vector", (embed or embedder())(F.col("q")))
    return cleaned.join(vectors, "q").select("query_id", "vector")


def embed_missing(rows: DataFrame, cache: DataFrame, text: str = "text", embed=None) -> DataFrame:
    """Rows with ``embedding``: the cached one of their text, or a new one; ``cache``: ``cache_key, embedding``."""
    from colophon.sources.collections import with_cached

    have, lack = with_cached(rows, cache, text)
    return have.unionByName(lack.withColumn("embedding", (embed or embedder())(F.col(text))))


def same_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> Column:
    """Whether every vector has ``dim`` components, as a one-row aggregate column."""
    return F.coalesce(F.min(F.size(vector) == dim), F.lit(True))
