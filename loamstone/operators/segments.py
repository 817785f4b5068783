"""A full-text index in segments: appends write what is new, levels are merged, and searches skip blocks that cannot matter.

A segment is an immutable folder of a versioned table (sources.versions). Its rows are blocks, the postings of a term in a range of
WIDTH document numbers: at most WIDTH entries (document, length, term frequency) beside the largest frequency and the least length
in it, which bound what any document of the block can score for the term. The documents themselves are the blocks of the empty term.
Rows are dealt by range, so that texts are shuffled once and words never, and sorted by term, so that a scan skips the pages of other terms.

Search reads those few numbers of the blocks of its terms first. The bound of a range is the sum over the question's terms; the best ranges
that hold k documents are scored, and then only ranges whose bound reaches the k-th score so far. The result is that of scoring everything.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.operators.fts import K1, B, counted
from loamstone.operators.joins import among, small_side
from loamstone.sources import versions

#: Document numbers in a block.
WIDTH = 4096
#: Scores nearer than this count as equal; bounds are widened by as much.
SLACK = 1e-8


def blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key long, text) -> term, range, df, max_tf, min_len, entries. Rows with a null key are in no index.

    Texts are dealt by range, and all else happens where they are.
    """
    docs = docs.where(F.col(key).isNotNull()).select(F.floor(F.col(key).cast("long") / WIDTH).alias("range"), F.col(key).cast("long").alias("doc"), "text")
    each = counted(docs.repartition("range"), ["range", "doc"], marked=True)
    entry = F.struct("doc", F.col("len").cast("long").alias("len"), "tf")
    return each.groupBy("term", "range").agg(
        F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("len").cast("long").alias("min_len"), F.sort_array(F.collect_list(entry)).alias("entries")
    )


def _laid_out(df: DataFrame) -> DataFrame:
    """By term in each file, of what is dealt by range: a search reads the pages of its terms in each."""
    return df.sortWithinPartitions("term", "range")


def append(docs: DataFrame, path: str, key: str = "doc_id") -> int:
    """Add documents that the index does not hold, as a segment of their own."""
    return versions.append(_laid_out(blocks(docs, key)), path)


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The segments of the last version with their numbers of documents."""
    last = max(versions.numbers(spark, path), default=0)
    count = lambda name: spark.read.parquet(f"{path}/data/{name}").where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return {name: count(name) for name in (versions.folders(spark, path, last) if last else [])}


def merge_levels(spark: SparkSession, path: str, fanout: int = 4) -> int:
    """Merge `fanout` or more segments of a level (the logarithm of their documents) into one until no level has as many; how many merges.

    A document is so rewritten once a level. Blocks of one term and range are joined; no text is read again.
    """
    merges = 0
    while True:
        levels: dict[int, list[str]] = {}
        for name, n in sizes(spark, path).items():
            levels.setdefault(floor(log(max(n, 1), fanout) + 1e-9), []).append(name)
        full = next((names for _, names in sorted(levels.items()) if len(names) >= fanout), None)
        if full is None:
            return merges
        old = spark.read.parquet(*(f"{path}/data/{name}" for name in full))
        joined = old.repartition("range").groupBy("term", "range").agg(
            F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries")
        )
        versions.swap(_laid_out(joined), path, full)
        merges += 1


def _weight(tf: Column, length: Column) -> Column:
    """BM25 of a term in a document, without its idf: it grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, scratch: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """queries (qid, term), distinct -> (qid, key, score, rank of the best k, ties by key; qid, ranges, read: of all ranges that hold
    a term, how many were scored). scratch: a new folder for what is read more than once."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    table = versions.read(spark, path)
    whole = table.where("term = ''").select("df", F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["len"]).alias("len"))
    corpus = whole.agg(F.sum("df").alias("n"), (F.sum("len") / F.sum("df")).alias("avg_len"))
    asked = small_side(queries.select("qid", "term").where("term <> ''"))
    postings = among(table, queries, "term").where("term <> ''")
    heads = postings.select("term", "range", "df", "max_tf", "min_len")
    idf = F.log(1 + (F.col("n") - F.col("all_df") + 0.5) / (F.col("all_df") + 0.5))
    found_in = heads.groupBy("term").agg(F.sum("df").alias("all_df")).join(F.broadcast(corpus)).select("term", idf.alias("idf"), "avg_len")
    terms = keep(found_in, "terms")
    tops = heads.join(small_side(terms), "term").groupBy("term", "range").agg(
        F.max(F.col("idf") * _weight(F.col("max_tf"), F.col("min_len"))).alias("most"), F.sum("df").alias("df")
    )
    bounds = tops.join(asked, "term").groupBy("qid", "range").agg(F.sum("most").alias("bound"), F.max("df").alias("least_docs"))
    better = W.partitionBy("qid").orderBy(F.desc("bound"), "range").rowsBetween(W.unboundedPreceding, -1)
    bounds = keep(bounds.select("*", F.coalesce(F.sum("least_docs").over(better), F.lit(0)).alias("before")), "bounds")

    def scored(ranges: DataFrame) -> DataFrame:
        wanted = ranges.select("qid", "range").join(asked, "qid")
        hits = postings.join(small_side(terms), "term").join(wanted, ["term", "range"]).select("qid", "idf", "avg_len", F.explode("entries").alias("e"))
        return hits.groupBy("qid", F.col("e.doc").alias(key)).agg(F.sum(F.col("idf") * _weight(F.col("e.tf"), F.col("e.len"))).alias("score"))

    def best(scores: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), key))
        return scores.withColumn("rank", rank).where(F.col("rank") <= k)

    first = keep(best(scored(bounds.where(F.col("before") < k))), "first")
    floor_of = first.groupBy("qid").agg(F.count("*").alias("held"), F.min("score").alias("least"))
    more = bounds.where(F.col("before") >= k).join(floor_of, "qid").where((F.col("held") < k) | (F.col("bound") >= F.col("least") - SLACK))
    more = keep(more.select("qid", "range"), "more")
    done = best(first.select("qid", key, "score").unionByName(scored(more)))
    read = bounds.groupBy("qid").agg(F.count("*").alias("ranges"), F.count_if(F.col("before") < k).alias("r")).join(more.groupBy("qid").agg(F.count("*").alias("m")), "qid", "left")
    return done, read.select("qid", "ranges", (F.col("r") + F.coalesce("m", F.lit(0))).alias("read"))
