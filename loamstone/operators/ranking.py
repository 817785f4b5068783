"""Vector top-k, relevance, reranking and budgeted context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.sources import short
from loamstone.functions.text import head, strip
from loamstone.functions.vectors import is_usable, squared_l2
from loamstone.operators.predicates import low_quality

TOP_K_FETCH, TOP_K_CONTEXT, TOP_K_USER = 32, 8, 4
MAX_CONTEXT_CHARS = 14_000
NO_DISTANCE = 999.0
#: Bytes of question vectors that are sent to the tasks at once, and questions in one matrix product.
QUESTION_BYTES = 32 << 20
TILE = 2048


def top_k(chunks: DataFrame, query: list[float], k: int = TOP_K_FETCH, key: str = "id") -> DataFrame:
    """chunks (key, vector, ...) with _distance (squared L2), nearest first; ties by key. One pass, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.where(is_usable(F.col("vector"))).withColumn("_distance", squared_l2(F.col("vector"), q))
    return scored.orderBy("_distance", key).limit(k)


def top_k_join(queries: DataFrame, chunks: DataFrame, k: int, key: str = "id", block: int | None = None, *, quantised: bool = False) -> DataFrame:
    """queries (qid long, vector) against all chunks -> qid, key, _distance, rank; vectors of one length.

    Queries are sent to the chunks in blocks of QUESTION_BYTES, one pass over
    the chunks for each, so a batch of questions takes one pass and chunks are never shuffled. A batch of chunks is compared by matrix products
    (Arrow UDF) and gives the best k of each query it holds, so that only these are shuffled.
    With quantised, sign bits leave out the chunks that they prove to be too far; the result is the same.
    """
    nearest = _nearest_by_bits if quantised else _nearest_of
    usable = chunks.where(is_usable(F.col("vector"))).select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where(is_usable(F.col("vector"))).select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    first = asked.first()
    block = block or QUESTION_BYTES // (8 * max(len(first["vector"]) if first else 1, 1))
    rows = asked.limit(block + 1).collect()
    n = 1 if len(rows) <= block else -(-asked.count() // block)
    near = usable.sparkSession.createDataFrame([], "qid long, id long, _distance double")
    for part in range(n if rows else 0):
        some = rows if n == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == part).collect()
        some = sorted(some, key=lambda r: r["qid"])
        tiles = [nearest(some[i : i + TILE], k) for i in range(0, len(some), TILE)]  # one scan, products of bounded size
        made = usable.mapInArrow(_in_turn(tiles), "qid long, id long, _distance double")
        near = made if n == 1 else near.unionByName(made)
    rank = F.row_number().over(W.partitionBy("qid").orderBy("_distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", key)


def _in_turn(functions: list):
    """Each batch through every one of the batch functions."""
    if len(functions) == 1:
        return functions[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in functions:
                yield from f(iter([batch]))

    return run


def _nearest_of(rows: list, k: int):
    """A batch function for one block of queries."""
    qid = np.array([r["qid"] for r in rows], dtype=np.int64)
    q = np.array([r["vector"] for r in rows], dtype=np.float64)
    q2 = (q * q).sum(axis=1) if len(rows) else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch) if len(qid) else 0, 4096):
                part = batch.slice(first, 4096)
                ids = np.asarray(part.column(0))
                m = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(part), -1)
                rough = (m * m).sum(axis=1)[:, None] + q2 - 2 * (m @ q.T)
                take = min(k, len(part))
                # Whatever is within rounding of the k-th best is kept and computed exactly.
                limit = np.partition(rough, take - 1, axis=0)[take - 1] + 1e-9 * (1 + q2)
                row, which = np.nonzero(rough <= limit)
                exact = ((m[row] - q[which]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[which]), pa.array(ids[row]), pa.array(exact)], ["qid", "id", "_distance"]
                )

    return run


def _nearest_by_bits(rows: list, k: int, oversample: int = 8, size: int = 1024):
    """As _nearest_of, with sign bits first.

    The oversample * k rows of a part nearest by Hamming distance are compared exactly; the k-th best of them bounds the
    k-th best of all. Where signs differ, (x - q)^2 >= q^2, so a row whose sum of these q^2 is beyond the bound is out.
    All others are compared.
    """
    qid = np.array([r["qid"] for r in rows], dtype=np.int64)
    q = np.array([r["vector"] for r in rows], dtype=np.float64)
    q2 = (q * q).sum(axis=1) if len(rows) else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.full(len(qid), np.inf)  # of the k-th best distance of each query, over the parts so far
        up = q > 0
        where_up, where_down = (q * q * up).T, (q * q * ~up).T
        signs = np.where(up, 1, -1).astype(np.float32).T
        for batch in batches:
            for first in range(0, len(batch) if len(qid) else 0, size):
                part = batch.slice(first, size)
                ids = np.asarray(part.column(0))
                m = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(len(part), -1)
                bits = m > 0
                if len(part) >= k:
                    coarse = min(oversample * k, len(part))
                    alike = np.where(bits, 1, -1).astype(np.float32) @ signs
                    close = np.argpartition(-alike, coarse - 1, axis=0)[:coarse]
                    for j in range(len(qid)):
                        d = ((m[close[:, j]] - q[j]) ** 2).sum(axis=1)
                        bound[j] = min(bound[j], np.partition(d, k - 1)[k - 1])
                slack = bound + 1e-9 * (1 + q2)
                possible = ~bits @ where_up + bits @ where_down <= slack
                left = np.flatnonzero(possible.any(axis=1))
                if not len(left):
                    continue
                rough = (m[left] ** 2).sum(axis=1)[:, None] + q2 - 2 * (m[left] @ q.T)
                rough[~possible[left]] = np.inf
                take = min(k, len(left))
                limit = np.minimum(np.partition(rough, take - 1, axis=0)[take - 1] + 1e-9 * (1 + q2), slack)
                row, which = np.nonzero(rough <= limit)
                row = left[row]
                exact = ((m[row] - q[which]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[which]), pa.array(ids[row]), pa.array(exact)], ["qid", "id", "_distance"]
                )

    return run


def relevance(distance: Column, boost: Column) -> Column:
    return 1.0 / (1.0 + F.coalesce(distance.cast("double"), F.lit(NO_DISTANCE))) * boost


def rerank(hits: DataFrame, boost: Column, blocked: Column, k: int) -> DataFrame:
    """hits (text, source, _distance, in_rank, ...) -> with score and out_rank.

    Noise, blocked sources and empty texts go first; then the first hit in input order of each 200-character prefix stays,
    whatever it scores; then by score, ties in input order.
    """
    text = strip(F.coalesce("text", F.lit("")))
    kept = hits.where(~low_quality(F.col("text"), F.col("source")) & ~blocked & (text != ""))
    first = F.row_number().over(W.partitionBy(head(text, 200)).orderBy("in_rank"))
    kept = kept.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    best = kept.withColumn("score", relevance(F.col("_distance"), boost)).orderBy(F.desc("score"), "in_rank").limit(k)
    return best.withColumn("out_rank", F.row_number().over(W.orderBy(F.desc("score"), "in_rank")))


def context_blocks(hits: DataFrame, budget: int = MAX_CONTEXT_CHARS, group: list[str] | None = None) -> DataFrame:
    """hits (text, source, rank) -> with n (citation number), block, total; up to the first block that does not fit.

    Lengths are positive, so the running total is increasing and the filter stops where a loop would.
    """
    by = W.partitionBy(*(group or [])).orderBy("rank")
    n = F.row_number().over(by)
    text, label = strip(F.coalesce("text", F.lit(""))), short(F.coalesce("source", F.lit("unknown")))
    block = F.concat(F.lit("["), n.cast("string"), F.lit("] "), label, F.lit("\n"), text, F.lit("\n"))
    numbered = hits.select("*", n.alias("n"), block.alias("block"))
    total = F.sum(F.length("block")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("total", total).where(F.col("total") <= budget)


def context(blocks: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The text of a context and its sources, in order; a context has few blocks by its budget."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block", "source")))
    made = blocks.groupBy(*(group or [])).agg(ordered.alias("b"))
    return made.select(
        *(group or []),
        F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"),
        F.transform("b", lambda x: x["source"]).alias("sources"),
    )


def two_branch(hits: DataFrame, user: Column, k: int = TOP_K_CONTEXT, k_user: int = TOP_K_USER) -> DataFrame:
    """The best k general and k_user project hits by rank."""
    rank = F.row_number().over(W.partitionBy("branch").orderBy("rank"))
    ranked = hits.withColumn("branch", F.when(user, "user").otherwise("general")).withColumn("branch_rank", rank)
    return ranked.where(F.col("branch_rank") <= F.when(F.col("branch") == "user", k_user).otherwise(k))


def latest_release(files: DataFrame, fallback: str) -> DataFrame:
    """The largest name in string order, else the fallback."""
    return files.agg(F.coalesce(F.max("filename"), F.lit(fallback)).alias("filename"))


def most_recent(entries: DataFrame, n: int) -> DataFrame:
    """The n entries that were accessed last; ties by insertion."""
    return entries.orderBy(F.desc("last_access"), F.desc("seq")).limit(n)
