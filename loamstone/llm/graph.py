"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialise


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, component): the smallest id that a node of a link reaches.

    Alternates the large-star and small-star steps until the edges stay the
    same. Each step is a minimum with map-side combine and a join that can
    be split where skewed; no neighbour list is ever gathered.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(links.select(lo.alias("a"), hi.alias("b")).where("a < b").distinct(), "edges")
    seen = _digest(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        least = materialise(least, "least")
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = materialise(large, "large")
        least2 = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        moved = large.join(least2, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        small = materialise(moved.union(least2.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        discard(edges, least, large, least2)
        edges, now = small, _digest(small)
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(tops)
