"""Embedding of texts through a pluggable model, once loaded for each worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.operators.domains import enhanced

Model = Callable[[list[str]], np.ndarray]


def hashing_model(dim: int = 384) -> Model:
    """A deterministic stand-in for a trained model: signed counts of hashed words, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return encode


def embedded(df: DataFrame, load: Callable[[], Model], *, batch: int = 512, lazy: bool = False) -> DataFrame:
    """df (text, ...) with vector. lazy: null vectors, for a later backfill. A batch that fails is retried row by row; rows that fail are null."""
    if lazy:
        return df.withColumn("vector", F.lit(None).cast("array<float>"))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, kind = load(), pa.list_(pa.float32())

        def safely(texts: list[str]) -> list:
            try:
                return list(model(texts))
            except Exception:
                return [None] if len(texts) == 1 else [v for t in texts for v in safely([t])]

        for part in parts:  # only the texts of a batch of the model are Python strings at a time
            made = [pa.array(safely([t or "" for t in part.slice(i, batch).to_pylist()]), kind) for i in range(0, len(part), batch)]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    # Not deterministic as far as the optimizer knows, so that a filter on the vectors does not embed once more.
    encode = encode.asNondeterministic()
    return df.withColumn("vector", encode("text"))


def embed_queries(queries: DataFrame, load: Callable[[], Model], *, names: Column | None = None, universal: Column | None = None, batch: int = 32) -> DataFrame:
    """queries (query, ...) with vector, in micro-batches; questions are enhanced by the domains' names first, where these are given."""
    text = F.col("query") if names is None else enhanced(F.col("query"), names, F.lit(False) if universal is None else universal)
    return embedded(queries.withColumn("text", text), load, batch=batch).drop("text")


def embed_query(spark: SparkSession, query: str, load: Callable[[], Model], **params) -> list[float] | None:
    """The vector of one question, or None if the model fails on it."""
    one = embed_queries(spark.createDataFrame([(query,)], "query string"), load, **params).first()["vector"]
    return None if one is None else list(one)


def with_vectors(df: DataFrame) -> DataFrame:
    """Rows whose text could be embedded."""
    return df.where(F.col("vector").isNotNull())


def backfilled(chunks: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """chunks with the missing vectors filled in; only their rows reach the model."""
    have, lack = chunks.where("vector IS NOT NULL"), chunks.where("vector IS NULL").drop("vector")
    return have.unionByName(embedded(lack, load))


def checked_dim(vector: Column, dim: int) -> Column:
    return F.size(vector) == dim
