"""Chunking: fixed windows in the JVM, recursive splitting over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.functions.text import strip

SEPARATORS = ("\n\n", "\n", " ", "")
#: Texts that are Python strings at once.
SLICE = 64


def fixed_chunks(df: DataFrame, size: int = 1500) -> DataFrame:
    """df (text, ...) -> its other columns, chunk_no, chunk: stripped windows of `size` code points, empty ones dropped."""
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    pieces = F.transform(starts, lambda i: strip(F.substring(F.col("text"), i * size + 1, F.lit(size))))
    others = [c for c in df.columns if c != "text"]
    return df.select(*others, F.posexplode(pieces).alias("chunk_no", "chunk")).where("chunk <> ''")


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that a piece holds.

    Neighbouring pieces are packed until the next would not fit; a new chunk starts with the
    last pieces of the one before, as many as `overlap` characters hold. Separators stay at the start of the piece they precede.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[level], separators[level + 1 :]
    if sep:
        first, *rest = text.split(sep)
        pieces = [p for p in (first, *(sep + r for r in rest)) if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    window: list[str] = []
    length = 0

    def close() -> None:
        if (chunk := "".join(window).strip()):
            chunks.append(chunk)

    for piece in pieces:
        if len(piece) >= size and finer:  # only shorter pieces are packed as they are
            close()
            window, length = [], 0
            chunks += split_recursively(piece, size, overlap, finer)
            continue
        if length + len(piece) > size and window:
            close()
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    close()
    return chunks


def recursive_chunks(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """df (text, ...) -> its other columns, chunk_no, chunk."""

    others = [c for c in df.columns if c != "text"]
    kind = T.StructType([*(df.schema[c] for c in others), T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), SLICE):  # so that neither the texts nor the chunks of a batch are held at once
                part = batch.slice(first, SLICE)
                cut = [split_recursively(t, size, overlap) if t else [] for t in part.column(len(others)).to_pylist()]
                row = pa.array([i for i, chunks in enumerate(cut) for _ in chunks], pa.int64())
                numbers = pa.array([n for chunks in cut for n in range(len(chunks))], pa.int32())
                made = [*(c.take(row) for c in part.columns[:-1]), numbers, pa.array([c for chunks in cut for c in chunks], pa.string())]
                yield pa.RecordBatch.from_arrays(made, [*others, "chunk_no", "chunk"])

    return df.select(*others, "text").mapInArrow(split, kind)


def chunk_records(df: DataFrame, vector: Column | None = None) -> DataFrame:
    """(source, chunk) rows as chunk records; without vectors they are null until a backfill."""
    vector = F.lit(None) if vector is None else vector
    return df.select(
        vector.cast("array<float>").alias("vector"),
        F.col("chunk").alias("text"),
        "source",
        F.current_timestamp().alias("timestamp"),
    )
