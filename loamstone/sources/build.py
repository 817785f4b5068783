"""Building the table of chunks from several sources, so that a rerun adds only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.operators.chunking import chunk_records, fixed_chunks
from loamstone.operators.joins import unseen
from loamstone.operators.predicates import indexable
from loamstone.sources.sinks import append


def incremental_build(
    spark: SparkSession, table: str, parts: list[DataFrame], *, blocked=(), size: int = 1500, chunk: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """parts (source, text), such as documents and then project files: their union, without the sources that the table holds, is filtered, cut and appended.

    The names are compared before any text is filtered or cut. A table that is not there is made; a table that cannot be read is an error.
    """
    whole = parts[0].select("source", "text")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("source", "text"))
    try:
        stored = spark.read.parquet(table)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        whole = unseen(whole, stored)
    cut = chunk or (lambda df: fixed_chunks(df, size))
    append(chunk_records(cut(whole.where(indexable(F.col("text"), F.col("source"), blocked)))), table)
