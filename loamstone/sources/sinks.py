"""Writers. Inputs are never deleted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import safe_filename, titled
from loamstone.operators.joins import first_by, unseen


def append(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def append_unseen(chunks: DataFrame, path: str) -> None:
    """Append the chunks of sources that the table does not hold, so that a rerun adds nothing."""
    existing = chunks.sparkSession.read.parquet(path)
    append(unseen(chunks, existing), path)


def replace(chunks: DataFrame, path: str) -> None:
    """A wipe and rebuild of the table."""
    chunks.write.mode("overwrite").parquet(path)


def append_by_tenant(chunks: DataFrame, path: str) -> None:
    """One directory a tenant; readers prune by tenant_id."""
    chunks.write.mode("append").partitionBy("tenant_id").parquet(path)


def within_quota(chunks: DataFrame, stored: DataFrame, tenants: DataFrame) -> DataFrame:
    """chunks of tenants that stay within max_chunks with what they have stored."""
    have = stored.groupBy("tenant_id").agg(F.count("*").alias("_have"))
    new = chunks.groupBy("tenant_id").agg(F.count("*").alias("_new"))
    limit = tenants.select("tenant_id", "max_chunks")
    counts = new.join(have, "tenant_id", "left").join(limit, "tenant_id")
    fits = counts.where(F.col("_new") + F.coalesce("_have", F.lit(0)) <= F.col("max_chunks")).select("tenant_id")
    return chunks.join(fits, "tenant_id", "left_semi")


def jsonl(chunks: DataFrame, path: str, compression: str = "gzip") -> None:
    chunks.select("source", "text").write.mode("overwrite").option("compression", compression).json(path)


def articles(pages: DataFrame, path: str) -> None:
    """One text file for each article, in a folder by its safe name; of equal names the first page by pos is written, and what is there stays."""
    named = pages.withColumn("name", safe_filename(F.col("title")))
    once = first_by(named, ["name"], "pos").select("name", titled(F.col("title"), F.col("text")).alias("value"))
    try:
        there = pages.sparkSession.read.schema("value string, name string").text(path).select("name").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        once = unseen(once, there, "name")
    once.write.mode("append").partitionBy("name").text(path)


def compacted(df: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """Rewrite a table to few files of the advisory partition size; path must be another than df's."""
    df.hint("rebalance").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)


def tenants_json(tenants: DataFrame, path: str) -> None:
    """The tenants as one JSON document, a small dimension."""
    whole = tenants.agg(F.sort_array(F.collect_list(F.struct(*tenants.columns))).alias("tenants"))
    whole.coalesce(1).write.mode("overwrite").json(path)
