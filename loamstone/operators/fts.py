"""Full-text search: postings and BM25 as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.operators.joins import among, small_side

K1, B = 1.2, 0.75
TERM = r"[a-z0-9]+"


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, key: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """docs (key, text) -> term, key, len, tf; of the terms of `only` (term) alone, where it is given: others are never grouped."""
    if only is None:
        return counted(docs.repartition(key), [key])
    each = docs.select(key, terms(F.col("text")).alias("t")).select(key, F.size("t").alias("len"), F.explode_outer("t").alias("term"))
    each = each.where("term IS NOT NULL").join(small_side(only.select("term").distinct()), "term", "left_semi")
    return each.groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def counted(docs: DataFrame, keys: list[str], marked: bool = False) -> DataFrame:
    """docs (keys, text), dealt by some of the keys -> term, keys, len, tf: texts were shuffled, words are not.

    Each document's terms are sorted and their runs counted in its own row. Rows of equal keys and length count as one document, as in
    `postings`. If marked, each row of docs, with terms or without, also gives one row of the empty term, of frequency 0. The generators are
    outer ones, as the optimizer would compute the array of another once more, in a filter for rows without elements.
    """
    texts = docs.groupBy(*keys).agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    lists = texts.select(*keys, F.transform("texts", terms).alias("lists"))
    by_len = lists.select(*keys, "lists", F.explode_outer(F.array_distinct(F.transform("lists", F.size))).alias("len"))
    alike = by_len.select(*keys, "len", F.filter("lists", lambda t: F.size(t) == F.col("len")).alias("alike"))
    ordered = alike.select(*keys, "len", F.size("alike").alias("rows"), F.sort_array(F.flatten("alike")).alias("t"))
    end = F.size("t")
    at = F.filter(F.sequence(F.lit(0), end), lambda i: (i < end) & ~F.get("t", i).eqNullSafe(F.get("t", i - 1)))
    if marked:
        at = F.concat(at, F.array_repeat(end, F.col("rows")))
    runs = ordered.select(*keys, "len", "t", at.alias("at")).select(*keys, "len", "t", "at", F.posexplode_outer("at").alias("j", "i"))
    tf = F.coalesce(F.get("at", F.col("j") + 1), end) - F.col("i")
    return runs.where("i IS NOT NULL").select(F.coalesce(F.get("t", F.col("i")), F.lit("")).alias("term"), *keys, "len", tf.cast("long").alias("tf"))


def doc_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM)).alias("len"))


def build_index(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """(Re)build both tables; postings are dealt by document and sorted by term in each file, so that a query reads few pages of each."""
    postings(docs, key).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    doc_stats(docs, key).write.mode("overwrite").parquet(f"{path}/docstats")


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """queries (qid, term), distinct -> qid, key, score, rank of the best k of each; ties by key.

    The query terms prune the postings before anything is joined or summed, and what is left of them is found once: the
    largest tf is asked for so that both uses have the same columns and share one exchange.
    """
    size = stats.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = among(index, queries, "term").select("term", key, "len", "tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("_most"), F.max("len").alias("_len")).where("_most > 0 AND _len > 0").drop("_most", "_len")
    found = hits.join(small_side(queries), "term")
    scored = found.join(df, "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = scored.groupBy("qid", key).agg(F.sum(idf * weight).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), key))  # sums differ in their last bits
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def fused(a: DataFrame, b: DataFrame, k: int, key: str = "doc_id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, key, rank)."""
    both = a.select("qid", key, "rank").unionByName(b.select("qid", key, "rank"))
    scores = both.groupBy("qid", key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round("score", 9).desc(), key))  # sums differ in their last bits
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
