"""Incremental ingest: a file stream whose batches append what the table does not hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamstone.operators.chunking import chunk_records, fixed_chunks
from loamstone.operators.predicates import indexable
from loamstone.sources.files import drop_replacement
from loamstone.sources.sinks import append, append_unseen


def text_stream(spark: SparkSession, path: str, files_a_batch: int = 50) -> DataFrame:
    """source, text of files as they arrive; the batch size is the back-pressure."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("source"), drop_replacement(F.col("value")).alias("text"))


def ingest(stream: DataFrame, table: str, checkpoint: str, *, size: int = 1500, blocked=(), chunk: Callable | None = None) -> StreamingQuery:
    """Filter, chunk and append until what is there now is read. A rerun or a repeated batch adds nothing."""
    make = chunk or (lambda df: fixed_chunks(df, size))

    def write(batch: DataFrame, number: int) -> None:
        records = chunk_records(make(batch.where(indexable(F.col("text"), F.col("source"), blocked))))
        try:
            batch.sparkSession.read.parquet(table)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            append(records, table)
        else:
            append_unseen(records, table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
