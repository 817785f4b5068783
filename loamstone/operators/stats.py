"""Counts and rates over tables, runs and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import basename, guarded_rate, head
from loamstone.operators.ranking import relevance


def source_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by source and, with a null source and grand_total set, overall."""
    return chunks.rollup("source").agg(F.count("*").alias("n_chunks"), F.grouping("source").alias("grand_total"))


def run_counts(files: DataFrame) -> DataFrame:
    """files (n_records, seconds) -> done, skipped, chunks and rates; a file is done if it gave a record."""
    done, chunks, seconds = F.count_if(F.col("n_records") > 0), F.sum("n_records"), F.sum("seconds")
    return files.agg(
        done.alias("done"),
        F.count_if(F.coalesce("n_records", F.lit(0)) == 0).alias("skipped"),
        F.coalesce(chunks, F.lit(0)).alias("chunks"),
        guarded_rate(F.count("*"), seconds).alias("files_a_second"),
        guarded_rate(chunks, seconds).alias("chunks_a_second"),
    )


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """outcomes (outcome: l1, l2 or miss) -> hits, misses and the hit rate."""
    l1, l2, miss = (F.count_if(F.col("outcome") == o) for o in ("l1", "l2", "miss"))
    return outcomes.agg(
        l1.alias("l1_hits"), l2.alias("l2_hits"), (l1 + l2).alias("total_hits"), miss.alias("total_misses"),
        guarded_rate(l1 + l2, l1 + l2 + miss).alias("hit_rate"),
    )


def tenant_stats(requests: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """requests (tenant_id, ts) -> requests of the last seconds before now, by tenant."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return requests.groupBy("tenant_id").agg(
        F.count("*").alias("n_requests"), F.count_if((age >= 0) & (age < seconds * 1_000_000)).alias("n_recent")
    )


def all_ok(checks: DataFrame) -> DataFrame:
    """checks (ok) -> whether all are; null counts as failed."""
    return checks.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))


def hit_summary(hits: DataFrame, boost: Column) -> DataFrame:
    """hits (qid, source, _distance) -> the best relevance, its distance and the start of its source's last part."""
    scored = hits.select("qid", relevance(F.col("_distance"), boost).alias("score"), "_distance", "source")
    best = scored.groupBy("qid").agg(F.max(F.struct("score", -F.col("_distance"), "source")).alias("b"))
    return best.select("qid", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("distance"), head(basename(F.col("b.source")), 48).alias("label"))
