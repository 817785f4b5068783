"""Domains: dimension rows that steer blocking, boosts, seeds and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.text import strip

#: Neutral domains of our own; users bring theirs as a table of the same columns.
DOMAINS = [
    ("it", "Informatics", ["spam", "tracker"], ["server", "code"], ["software", "network"], ["Linux", "Databases", "Networks"]),
    ("law", "Law", ["gossip"], ["statute", "court"], ["statute", "court"], ["Contracts", "Databases"]),
    ("universal", "Everything", [], [], [], []),
]
COLUMNS = "id string, name string, blocked array<string>, signals array<string>, keywords array<string>, seeds array<string>"
DEFAULT_DOMAIN = "it"


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DOMAINS)], f"ord int, {COLUMNS}")


def active(domains: DataFrame, ids: list[str], default: str = DEFAULT_DOMAIN) -> DataFrame:
    """The domains of valid ids; the default one if none is valid. One pass over the dimension."""
    valid = F.col("id").isin(ids)
    flagged = domains.withColumn("_any", F.max(valid).over(W.partitionBy()))
    return flagged.where(F.when(F.col("_any"), valid).otherwise(F.col("id") == default)).drop("_any")


def is_universal(ids: Column) -> Column:
    return F.exists(ids, lambda x: x == "universal")


def merged(domains: DataFrame, column: str, default: list[str] | None = None) -> DataFrame:
    """The values of an array column in order of first appearance, each once; default values if there are none."""
    rows = domains.select("ord", F.posexplode(column).alias("pos", "value"))
    found = rows.groupBy("value").agg(F.min(F.struct("ord", "pos")).alias("first"))
    if default:
        spark = domains.sparkSession
        others = spark.createDataFrame([(v, i) for i, v in enumerate(default)], "value string, pos int")
        others = others.select("value", F.struct(F.lit(0).alias("ord"), "pos").alias("first"))
        found = found.unionByName(others.join(found.agg(F.count("*").alias("n")), F.col("n") == 0).drop("n"))
    return found.orderBy("first").select("value", "first")


def _as_list(domains: DataFrame, column: str) -> DataFrame:
    """One row with the merged values of a column as an array, in order."""
    return merged(domains, column).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias(column))


def link_keywords(domains: DataFrame) -> DataFrame:
    """One row: the keywords of links that a crawl for these domains follows."""
    return _as_list(domains, "keywords")


def blocked_patterns(domains: DataFrame) -> DataFrame:
    """One row: the patterns that bar a link or source from these domains."""
    return _as_list(domains, "blocked")


def enhanced(query: Column, names: Column, universal: Column) -> Column:
    """A question with the domains' names before it, unless it starts with one or the mode is universal."""
    q = strip(query)
    named = F.exists(names, lambda n: F.lower(q).startswith(F.substring(F.lower(n), 1, 6)))
    return F.when(universal | named, q).otherwise(F.concat(F.array_join(names, " "), F.lit(": "), q))


def signal_count(text: Column, signals: Column) -> Column:
    """How many of the signals a text contains."""
    return F.size(F.filter(signals, lambda s: F.lower(text).contains(s)))


def distinct_map(tags: Column, value: Column) -> Column:
    """A list of keys, some listed twice, as a map."""
    return F.map_from_entries(F.transform(F.array_distinct(tags), lambda t: F.struct(t, value)))
