"""A crawl's frontier as tables, expanded by rounds of joins.

Waiting topics (topic, pos) are taken in the order of pos. A round takes the first `batch` of them, finds what they link to, and
puts topics that were not seen before at the end of the queue, in the order in which a plain queue would meet them: by the place of the topic
that links first, then by the link's place in it. No list of all topics is held in a row or on the driver: a round
collects nothing but the last place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.operators.asof import SLICES, slice_of
from loamstone.sources.catalog import MAX_QUEUE


def expand(waiting: DataFrame, done: DataFrame, links: DataFrame, batch: int, most: int | None = MAX_QUEUE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """waiting (topic, pos), done (topic), links (topic, link, ord) -> taken (topic, pos), and waiting and done after them.

    most: topics that wait at most, the first ones; those beyond are forgotten and may be met again. None: no limit. Null
    topics and links are no topics; of a topic that waits twice the first place counts; links of a topic that is not taken wait for it.
    """
    queue = waiting.where("topic IS NOT NULL").groupBy("topic").agg(F.min("pos").alias("pos")).join(done.select("topic").distinct(), "topic", "left_anti")
    taken = queue.orderBy("pos", "topic").limit(batch)
    left = queue.join(taken.select("topic"), "topic", "left_anti")
    met = links.where("link IS NOT NULL").join(taken, "topic").groupBy(F.col("link").alias("topic")).agg(F.min(F.struct("pos", "ord")).alias("first"))
    for seen in (queue, done):
        met = met.join(seen.select("topic"), "topic", "left_anti")
    last = queue.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    if most is not None:  # what is numbered below is then as few
        met = met.orderBy("first", "topic").limit(most)
    new = numbered(met, last)
    after = left.select("topic", "pos").unionByName(new)
    if most is not None:
        after = after.orderBy("pos", "topic").limit(most)
    return taken, after, done.select("topic").unionByName(taken.select("topic"))


def numbered(met: DataFrame, last: int) -> DataFrame:
    """met (topic, first (pos, ord)) -> topic, pos: places after `last` by first, then topic.

    Rows are cut into slices of pos and numbered inside each; the slices' sizes, a row each, give where its numbers begin. Which slice a
    row is in depends on its values alone, so it is the same wherever it is computed.
    """
    rows = met.select("topic", "first", F.col("first.pos").cast("long").alias("t"))
    cuts = rows.agg(F.percentile_approx("t", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts")).first()["cuts"]
    rows = rows.withColumn("slice", F.expr(slice_of(sorted(set(cuts or [])))))
    inside = rows.select("topic", "slice", F.row_number().over(W.partitionBy("slice").orderBy("first", "topic")).alias("n"))
    sizes = rows.groupBy("slice").agg(F.count("*").alias("size"))
    before = sizes.select("slice", F.coalesce(F.sum("size").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inside.join(before, "slice").select("topic", (F.lit(last).cast("long") + F.col("before") + F.col("n")).alias("pos"))
