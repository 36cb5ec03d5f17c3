"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key (md5 of its id and its text's md5). Keys are uniform, so fixed ranges of the key
space are ranges of the sort order within a source; sums for each (source, range) are aggregated
before the shuffle, their prefix sums give each range its start, and a window within one range
finishes the prefix sums. A source, however large, is spread over all ranges. The mix takes whole
epochs of a source and then its rows in key order up to the exact budget; the row on the edge gives
only its first words.

A null source is a source of its own, last in order. Null and empty texts have size 0 and nothing
is taken of them. Null ids and texts hash like empty ones. Rows with equal ids are told apart by their
texts; rows equal in both are interchangeable. An empty table, or one without any word, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import WORD, checkpoint, fresh

#: Weights of the sources in order, repeating; share of all words that the mix holds; epochs at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows that one range of keys holds on average at most.
RANGE_ROWS = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hashed_key(key: str, text: str) -> Column:
    """md5 of the id, a colon and the text's md5."""
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.md5(F.concat(own, F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with `target`: weight times one level, at most epochs times the size.

    The level is where all targets sum to share times all sizes: sources sorted by the level at
    which they are full; the first so many are full, the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    full = F.col("source_size") * epochs / F.col("weight")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(full, "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * epochs).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"),
    ).withColumn("level", F.col("left") / F.col("rest"))
    # The level rises until it is one that the next source isn't full at, and falls from there on.
    level = F.max(F.when(F.col("level") <= full, F.col("level"))).over(everything)
    cap = (F.col("source_size") * epochs).cast("double")
    return levels.select("source", "source_size", F.least(cap, F.coalesce(level * F.col("weight"), cap)).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", row: str | None = None, **options) -> DataFrame:
    """A row (_row, key, source, size, source_size, target, taken) for each row of docs.

    `taken` is how many words the mix takes of it, repeats counted. `_row` is docs' column `row`, or null.
    """
    number = F.col(row) if row else F.lit(None).cast("long")
    light = checkpoint(
        docs.select(number.alias("_row"), F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), hashed_key(key, text).alias("hash"))
    )
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    digits = 1
    while most > RANGE_ROWS * 16**digits:
        digits += 1
    hashed = light.withColumn("range", F.substring("hash", 1, digits))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("source", "range")
        .agg(F.sum("size").alias("in_range"))
        .withColumn("start", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "start")
    )
    budgets = targets(sizes.select("source", "source_size"), **options).select(F.col("source").alias("t"), "source_size", "target")
    plan = starts.join(budgets, F.col("s").eqNullSafe(F.col("t")))
    within = Window.partitionBy("source", "range").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn(
        "before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("_row", F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the mix takes words of, with `mix_size` and `mix_taken` in place of columns so called."""
    docs = docs.drop("mix_size", "mix_taken")
    row = fresh(docs, "_row")
    numbered = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))  # a number is only good while rows keep it
    mixed = mix(numbered, text, source, key, row, **options).where("taken > 0")
    return numbered.join(mixed.select(F.col("_row").alias(row), F.col("size").alias("mix_size"), F.col("taken").alias("mix_taken")), row).drop(row)
