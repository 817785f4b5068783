"""Vector arithmetic on arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    n = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return F.transform(_doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is the zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def is_usable(v: Column) -> Column:
    """Neither null nor a lazy zero vector, for which every distance is the same."""
    return v.isNotNull() & F.exists(v, lambda x: x != 0)


def sign_bits(v: Column, dim: int) -> Column:
    """Signs packed into longs, 64 to each: the binary quantisation of v."""
    words = []
    for first in range(0, dim, 64):
        part = F.slice(v, first + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    differing = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda s, x: s + x)
