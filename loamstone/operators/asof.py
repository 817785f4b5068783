"""As-of joins: for each row of one log the last row of another, of the same key and not later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of time at most; a key's rows are dealt over them, so a key that is asked all the time is many tasks.
SLICES = 256


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def slice_of(cuts: list[int], first: int = 0) -> str:
    """SQL for the number of cuts that are less than t, by halving."""
    if not cuts:
        return str(first)
    half = len(cuts) // 2
    return f"IF(t <= {cuts[half]}L, {slice_of(cuts[:half], first)}, {slice_of(cuts[half + 1 :], first + half + 1)})"


def as_of(probes: DataFrame, entries: DataFrame, slices: int = SLICES) -> DataFrame:
    """probes (key, t), entries (key, t, value), t in microseconds -> key, t of each distinct probe, found (t, value).

    Found is the last entry of the key that is not after the probe, of equal times that with the greatest value, null if there is none;
    rows with a null key or time match nothing and are left out.

    Both logs are merged by (key, time) and the last entry is carried forward, so rows grow with the logs and not with
    their pairs. Time is cut into slices of about equal numbers of rows. Inside a (key, slice) a running maximum carries the
    entry; what comes from earlier slices is a scan over one row a slice, joined back by (key, slice). Equal (key, time) rows are one row on either side.
    """
    there = "key IS NOT NULL AND t IS NOT NULL"
    stored = entries.where(there).groupBy("key", "t").agg(F.max("value").alias("value")).select("key", "t", F.struct("t", "value").alias("e"))
    asked = probes.where(there).select("key", "t").distinct()
    log = stored.select("*", F.lit(0).alias("kind")).unionByName(asked.select("*", F.lit(None).cast(stored.schema["e"].dataType).alias("e"), F.lit(1).alias("kind")))
    times = entries.select("t").unionByName(probes.select("t"))
    cuts = times.agg(F.percentile_approx("t", [i / slices for i in range(1, slices)] or [0.5], 10_000).alias("cuts")).first()["cuts"]
    log = log.withColumn("slice", F.expr(slice_of(sorted(set(cuts or [])))))
    last = F.max("e").over(W.partitionBy("key", "slice").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = log.withColumn("own", last).where("kind = 1").select("key", "slice", "t", "own")
    earlier = F.max("e").over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    carried = log.groupBy("key", "slice").agg(F.max("e").alias("e")).select("key", "slice", earlier.alias("carried"))
    return inside.join(carried, ["key", "slice"], "left").select("key", "t", F.coalesce("own", "carried").alias("found"))
