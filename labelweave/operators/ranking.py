"""Orders over whole tables without a task that holds one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint

#: Ranges that a table is dealt into at least.
RANGES = 16


def _ranges(df: DataFrame, ranges: int | None) -> int:
    return ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *order: Column | str, ranges: int | None = None) -> DataFrame:
    """df with `_range`, a number that never falls along the order, kept in the checkpoint folder.

    Spark samples df for the limits of the ranges, so df is made twice, whatever is done with the result.
    Rows equal in all of `order` share a range: let it end with an id.
    """
    return checkpoint(df.repartitionByRange(_ranges(df, ranges), *order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, *order: Column | str, into: str = "n", ranges: int | None = None) -> DataFrame:
    """df with its rows' numbers in the order, from 0. The driver sees one count a range."""
    sorted_ = df.repartitionByRange(_ranges(df, ranges), *order).sortWithinPartitions(*order)
    own = checkpoint(sorted_.withColumn("_id", F.monotonically_increasing_id()))  # the range in the upper bits
    counts = own.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))  # as many rows as ranges
    rows = own.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(starts), "_range")
    return rows.withColumn(into, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_range", "_start")
