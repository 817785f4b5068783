"""Membership, pattern and nearest-neighbour joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.sources import DEFAULT_BOOST
from loamstone.functions.vectors import is_usable
from loamstone.operators.asof import as_of, micros
from loamstone.operators.patterns import first_matches


#: Rows of a side that is sent to all tasks, at most.
BROADCAST_ROWS = 100_000
#: Patterns that are matched by a nested loop of expressions; more go into automata.
FEW_PATTERNS = 32
#: Values that a scan is asked for by name, at most.
FEW_VALUES = 1_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has so few rows, as it is otherwise; reads no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of df whose column is among that of keys: by a filter that reaches the scan of df if these are few, else by a semi-join."""
    values = keys.select(column).where(F.col(column).isNotNull()).distinct()
    few = [r[0] for r in values.limit(FEW_VALUES + 1).collect()]
    if len(few) <= FEW_VALUES:
        return df.where(F.col(column).isin(few))
    return df.join(small_side(values), column, "left_semi")


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of few patterns to be broadcast to a nested loop; too many are an error."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"a table of patterns has at most {rows} rows")
    return F.broadcast(df)


def unseen(files: DataFrame, existing: DataFrame, key: str = "source") -> DataFrame:
    """files whose key is not in the table yet; reads one column of it. Duplicates among files stay."""
    return files.join(existing.select(key).distinct(), key, "left_anti")


def few(patterns: DataFrame) -> bool:
    """Whether a nested loop is good enough for so many; reads no more rows than that."""
    return patterns.limit(FEW_PATTERNS + 1).count() <= FEW_PATTERNS


def matching(sources: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct rows of sources (source) whose lower-cased name contains one of the patterns (pattern)."""
    if few(patterns):
        return sources.join(dimension(patterns, FEW_PATTERNS), F.lower("source").contains(F.col("pattern")), "left_semi")
    return first_matches(sources.select(F.col("source").alias("text")), patterns.select("pattern", F.lit(0).alias("ord"))).select(F.col("text").alias("source"))


def boosted(df: DataFrame, patterns: DataFrame, blocked: DataFrame) -> DataFrame:
    """df with `boost`: 0 if blocked, else the boost of the first pattern by `ord` that its source contains.

    patterns (pattern, boost, ord) and blocked (pattern) may be of any size; distinct sources are matched, not rows. Of equal
    ord the least boost is taken.
    """
    sources = df.select("source").distinct()
    if few(patterns):
        hit = sources.join(dimension(patterns, FEW_PATTERNS), F.lower("source").contains(F.col("pattern")))
        first = hit.groupBy("source").agg(F.min(F.struct("ord", "boost"))["boost"].alias("b"))
    else:
        ranked = first_matches(sources.select(F.col("source").alias("text")), patterns).withColumnRenamed("text", "source")
        first = ranked.join(patterns.groupBy("ord").agg(F.min("boost").alias("b")), "ord").select("source", "b")
    barred = matching(sources, blocked).withColumn("barred", F.lit(True))
    value = F.when(F.col("barred"), 0.0).otherwise(F.coalesce("b", F.lit(DEFAULT_BOOST)))
    by_source = sources.join(first, "source", "left").join(barred, "source", "left").select("source", value.alias("boost"))
    return df.join(by_source, "source", "left").withColumn("boost", F.coalesce("boost", F.lit(DEFAULT_BOOST)))


def tenants_of_keys(requests: DataFrame, tenants: DataFrame, *, multi_tenant: bool = True) -> DataFrame:
    """requests (headers map) -> with tenant_id of the enabled tenant whose key they carry, else null; all null if switched off."""
    plain = F.nullif(F.element_at("headers", "x-api-key"), F.lit(""))
    bearer = F.regexp_replace(F.element_at("headers", "authorization"), "^Bearer ", "")
    key = F.sha2(F.coalesce(plain, bearer), 256)
    enabled = tenants.where("enabled").select(F.col("api_key_hash").alias("_hash"), "tenant_id")
    if not multi_tenant:
        enabled = enabled.where(F.lit(False))
    return requests.withColumn("_key", key).join(enabled, F.col("_key") == F.col("_hash"), "left").drop("_key", "_hash")


def exact_cached(queries: DataFrame, entries: DataFrame, ttl_seconds: float) -> DataFrame:
    """queries (qid, query, ts), entries (query, result, created) -> qid, result: that of the last entry of the same
    query stored by then, if it is not over age. A row for each row of queries that has one; equal times go to the greatest result.

    An as-of join: a query asked and stored a million times is a merge of two logs and not their pairs."""
    asked = queries.select("qid", F.col("query").alias("key"), micros(F.col("ts")).alias("t"))
    stored = entries.select(F.col("query").alias("key"), micros(F.col("created")).alias("t"), F.col("result").alias("value"))
    hit = asked.join(as_of(asked, stored).where("found IS NOT NULL"), ["key", "t"])
    fresh = F.col("t") - F.col("found.t") <= int(ttl_seconds * 1_000_000)
    return hit.where(fresh).select("qid", F.col("found.value").alias("result"))


def nearest_cached(queries: DataFrame, cache: DataFrame, threshold: float, max_entries: int = 1000) -> DataFrame:
    """queries (qid long, vector), cache (entry long, vector) -> qid, entry, similarity of the most similar entry at or above threshold.

    A cache is bounded by its profile, so its matrix goes to the tasks with
    the function; queries meet it in matrix products (Arrow UDF). Equal similarities go to the earlier entry.
    A table of more entries than max_entries is taken in parts of so many, a pass over the queries for each.
    """
    usable = cache.select(F.col("entry").cast("long").alias("entry"), F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    rows = usable.limit(max_entries + 1).collect()
    if len(rows) <= max_entries:
        return _nearest_of_part(queries, rows, threshold)
    parts = -(-usable.count() // max_entries)
    found = None
    for i in range(parts):
        some = usable.where(F.pmod(F.xxhash64("entry"), F.lit(parts)) == i).collect()
        part = _nearest_of_part(queries, some, threshold)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("qid").agg(F.max(F.struct("similarity", -F.col("entry"))).alias("b"))
    return best.select("qid", (-F.col("b.col2")).alias("entry"), F.col("b.similarity").alias("similarity"))


def _nearest_of_part(queries: DataFrame, rows: list, threshold: float) -> DataFrame:
    rows = sorted(rows, key=lambda r: r["entry"])
    entries = np.array([r["entry"] for r in rows], dtype=np.int64)
    matrix = _unit_rows(np.array([r["vector"] for r in rows], dtype=np.float64)) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if matrix is None or not len(batch):
                continue
            q = _unit_rows(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(batch), -1))
            similarity = q @ matrix.T
            best = similarity.argmax(axis=1)
            top = similarity[np.arange(len(best)), best]
            hit = top >= threshold
            columns = [batch.column(0).filter(pa.array(hit)), pa.array(entries[best[hit]]), pa.array(top[hit])]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "entry", "similarity"])

    asked = queries.where(is_usable(F.col("vector"))).select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    return asked.mapInArrow(run, "qid long, entry long, similarity double")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def preferred_model(available: DataFrame, preferences) -> DataFrame:
    """available (name, ord) -> the name that the first preference fits, else the first name; one row, or none."""
    rank = F.lit(len(preferences))
    for i in reversed(range(len(preferences))):
        rank = F.when(F.lower("name").contains(preferences[i]), F.lit(i)).otherwise(rank)
    return available.agg(F.min_by("name", F.struct(rank, "ord")).alias("model")).where("model IS NOT NULL")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key, by order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
