"""Rows of a key as one sequence in a task, for functions that see batches and not groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df dealt so that all rows of a key are in one task, next to each other and in order.

    Dealt by a hash of the key, not by the key itself: a shuffle by what a join below has dealt its rows by is left out of the plan, and
    as no operator above states that it needs the rows of a key together, the join may then be planned anew so that they are not.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
