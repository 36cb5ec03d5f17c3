"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_zero(x: Column) -> Column:
    """Null, NaN and infinite values as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scaled_sigmoid(x: Column) -> Column:
    """Sigmoid of x - 0.5, over 0.5."""
    return sigmoid(x - 0.5) / 0.5


def hassanat(x: Column, y: Column) -> Column:
    """Distance of two arrays of values of 0 or more: the sum of 1 - (1 + min) / (1 + max)."""
    parts = F.zip_with(x, y, lambda a, b: 1 - (1 + F.least(a, b)) / (1 + F.greatest(a, b)))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
