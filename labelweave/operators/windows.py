"""Window specifications that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_totals(cells: DataFrame, by: tuple[str, ...] = ("label",), **totals: Column) -> DataFrame:
    """Cells with aggregates of their group as columns: summed before the shuffle and joined, so that no group is one task."""
    return cells.join(cells.groupBy(*by).agg(*[value.alias(name) for name, value in totals.items()]), list(by))


def best_first(*partition: str, score: str = "p", tie: tuple[str, ...] = ("gene",)) -> WindowSpec:
    """Scores from high to low within a partition, ties by id, so that every run gives the same ranks."""
    return Window.partitionBy(*partition).orderBy(F.desc(score), *tie)


#: Parts that a key's rows are ranked in before the best of all parts are.
PARTS = 32


def value_at_rank(rows: DataFrame, key: str, value: str, tie: str, k: int, into: str = "_least") -> DataFrame:
    """(key, into): the value at rank k (from 0, largest first) of each key; keys with fewer rows have none.

    The k + 1 best of every part of a key, by hash of `tie`, are ranked again, so that no key's rows meet in one task.
    """
    order = [F.desc(value), tie]
    part = F.row_number().over(Window.partitionBy(key, F.pmod(F.xxhash64(tie), F.lit(PARTS))).orderBy(*order))
    few = rows.select(key, tie, value).withColumn("_part", part).where(F.col("_part") <= k + 1)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") == k + 1).select(key, F.col(value).alias(into))


RUNNING = (Window.unboundedPreceding, Window.currentRow)
