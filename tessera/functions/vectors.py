"""Vector columns: all sums are in double, whatever the elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null if the lengths differ or an element is null."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def clamp01(x: Column) -> Column:
    """NaN and null become 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0, or if one is null or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def sign_words(v: Column, size: int) -> Column:
    """Sign bits (1 for elements of 0 or more) in 32-bit words, as longs."""

    def word(at: int) -> Column:
        bits = F.slice(v, at + 1, 32)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x >= 0, 1).otherwise(0))

    return F.array(*[word(at) for at in range(0, size, 32)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
