"""Distance expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_array_distance(left: Column, right: Column) -> Column:
    """Squared distance of two numeric arrays of equal length."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, square: total + square)


def all_finite(values: Column) -> Column:
    """True if the array is given and none of its numbers is null, NaN or infinite."""
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return values.isNotNull() & ~odd
