"""Vector expressions on array<double> columns; all are built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is. The length is computed once, not for each element."""
    n = norm(v)
    bound = F.when(n > 0, n).otherwise(F.lit(1.0))
    return F.transform(F.array(bound), lambda length: F.transform(v, lambda x: x / length))[0]


def prefix(v: Column, dims: int) -> Column:
    """The first dims numbers, as a unit vector."""
    return unit(F.slice(v, 1, dims))


def composed(parts: list[tuple[Column, float]]) -> Column:
    """The unit vector of a weighted sum; weights must be positive."""
    if not parts or any(w <= 0 for _, w in parts):
        raise ValueError("a composition needs positive weights")
    total = scaled(parts[0][0], F.lit(float(parts[0][1])))
    for v, w in parts[1:]:
        total = F.zip_with(total, scaled(v, F.lit(float(w))), lambda s, x: s + x)
    return unit(total)


def joined(a: Column, b: Column) -> Column:
    """Two vectors end to end, as a unit vector."""
    return unit(F.concat(a, b))


def signs(v: Column) -> Column:
    """The sign bits as numbers 0 and 1."""
    return F.transform(v, lambda x: F.when(x >= 0, F.lit(1)).otherwise(F.lit(0)))


def mismatches(a: Column, b: Column) -> Column:
    """The Hamming distance of two arrays of bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.lit(1))), F.lit(0), lambda s, x: s + x)


def packed_signs(v: Column) -> Column:
    """The sign bits of a vector as longs of 64 bits each, the first component in the lowest bit: an eighth of a byte a dimension."""
    word = lambda w: F.aggregate(
        F.transform(F.slice(v, w * 64 + 1, F.lit(64)), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b),
    )
    words = F.ceil(F.size(v) / 64).cast("int")
    return F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), lambda w: word(w))).otherwise(F.expr("cast(array() as array<long>)"))
