"""Normalising and rescaling score cells (gene, label, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.functions.scalar import nan_to_zero, sigmoid
from labelweave.operators.metrics import ranked
from labelweave.operators.windows import with_totals


def placed(cells: DataFrame, by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells (*by, gene, label, p, *keep) with `rn`, the rank from the best score down within by and label, their number `n` and the sum of their scores `sum`.

    Scores that are null or no numbers are 0. Kept in the checkpoint folder, since what follows reads ranks more than once.
    """
    keyed = cells.select(*by, "gene", "label", "p", *keep, F.struct(*by, "label").alias("_key"), nan_to_zero(F.col("p")).alias("y"))
    return checkpoint(ranked(keyed, "_key", keep=(*by, *keep, "_key")).select(*by, "gene", "label", "p", *keep, "rn", "n", F.col("total").alias("sum")))


def quantile_norm(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each score becomes the scaled sum, over labels, of the scores of its rank; labels without any score stay 0.

    Columns `by` keep sets of cells apart.
    """
    rows = placed(cells, by)
    used = F.abs("sum") > 1e-9
    profile = rows.where(used).groupBy(*by, "rn").agg(F.sum("p").alias("_v"))
    ends = profile.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    joined = profile.join(ends, list(by)) if by else profile.join(F.broadcast(ends))
    share = F.coalesce((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0))  # one value for all ranks: 0
    scaled = joined.select(*by, "rn", share.alias("q"))
    return rows.join(scaled, [*by, "rn"], "left").select(*by, "gene", "label", F.when(used, F.col("q")).otherwise(0.0).alias("p"))


def quantile_norm_thresholds(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """quantile_norm() of scores (gene, label, p, t) with each label's threshold t ranked among them: scores (gene, label, p) and thresholds (label, t).

    A threshold stands behind the scores that reach it, so they reach it afterwards too; it adds nothing to its rank's sum. Labels without any score
    get threshold 1.
    """
    rows = placed(cells, keep=("t",)).withColumn("_rn", F.col("rn") + (F.col("p") < F.col("t")).cast("int"))
    used = F.abs("sum") > 1e-9
    profile = rows.where(used).groupBy("_rn").agg(F.sum("p").alias("_v"))
    ends = profile.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_k"))
    # Ranks that only thresholds have sum to 0.
    bare = F.col("_k") <= F.col("n")
    low, high = F.when(bare, F.least("_low", F.lit(0.0))).otherwise(F.col("_low")), F.when(bare, F.greatest("_high", F.lit(0.0))).otherwise(F.col("_high"))
    share = F.coalesce((F.coalesce("_v", F.lit(0.0)) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    own = rows.groupBy("label").agg(F.sum((F.col("p") >= F.col("t")).cast("long")).alias("_above"), F.max("n").alias("n"), F.max("sum").alias("sum")).withColumn("_rn", (F.col("_above") + 1).cast("double"))
    scaled = lambda x: x.join(profile, "_rn", "left").join(F.broadcast(ends), how="left")  # noqa: E731  one row of ends
    scores = scaled(rows).select("gene", "label", F.when(used, share).otherwise(0.0).alias("p"))
    return scores, scaled(own).select("label", F.when(used, share).otherwise(1.0).alias("t"))


def over_threshold(cells: DataFrame) -> DataFrame:
    """Scores (gene, label, p, t) over the label's threshold."""
    return cells.select("gene", "label", (F.col("p") / F.nullif(F.col("t"), F.lit(0.0))).alias("p"))


def column_max_scale(cells: DataFrame) -> DataFrame:
    """Each label's scores over the largest of them."""
    most = F.col("_most")
    return with_totals(cells, _most=F.max("p")).select("gene", "label", F.when(most > 0, F.col("p") / most).otherwise(F.col("p")).alias("p"))


def soft_threshold(cells: DataFrame) -> DataFrame:
    """Scores (gene, label, p, t) rescaled so that the label's threshold t becomes 0.5 and its largest score 1.

    A threshold of 1 or infinity, or one that no score reaches, leaves no score above 0.5: with 1
    and infinity all scores are 0, and so they are where the label's largest score stays below.
    """
    t = F.greatest("t", F.lit(1e-7))
    off = (F.col("t") == 1.0) | (F.abs("t") == float("inf"))
    rows = with_totals(cells.withColumn("_e", F.when(off, 0.0).otherwise(F.col("p") / t)), _most=F.max("_e"))
    most = F.greatest("_most", F.lit(0.0))
    e = F.when(off | ((most < 1) & (most > 0)), 0.0).otherwise(F.col("_e"))
    high = F.when(most > 1, (e - 1) / (most - 1) * 0.5 + 0.5).otherwise(0.5)
    return rows.select("gene", "label", F.when(e >= 1, high).otherwise(e * 0.5).alias("p"))


def zscore(cells: DataFrame) -> DataFrame:
    """z-scores of each label's column, scaled to 0..1; a column of one value becomes 0.

    Scaling to 0..1 undoes mean and deviation, so the least and the largest score say it all.
    """
    rows = with_totals(cells, _low=F.min("p"), _high=F.max("p"))
    return rows.select("gene", "label", F.coalesce((F.col("p") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)), F.lit(0.0)).alias("p"))


def rank_scale(cells: DataFrame) -> DataFrame:
    """Ranks (gene, label, p, t) above the label's threshold scaled to 0..1; scores at or below it give -1."""
    rows = placed(cells, keep=("t",)).withColumn("_v", (F.col("n") - F.col("rn") + 1) / F.col("n"))
    rows = with_totals(rows, _least=F.min(F.when(F.col("p") > F.col("t"), F.col("_v"))))
    t = F.least(F.coalesce("_least", F.lit(1.0)), F.lit(1.0))
    return rows.select("gene", "label", F.when((t < 1) & (F.col("_v") >= t), (F.col("_v") - t) / (1 - t)).otherwise(-1.0).alias("p"))


def mask(cells: DataFrame) -> DataFrame:
    """Scores (gene, label, p, t) below the threshold become 0."""
    return cells.select("gene", "label", F.when(F.col("p") >= F.col("t"), F.col("p")).otherwise(0.0).alias("p"))


def row_max_scale(cells: DataFrame) -> DataFrame:
    """Each gene's scores over the largest of them."""
    most = F.max("p").over(Window.partitionBy("gene"))
    return cells.select("gene", "label", F.when(most > 0, F.col("p") / most).otherwise(F.col("p")).alias("p"))


def column_scale(cells: DataFrame, rate: DataFrame) -> DataFrame:
    """Each label's scores over the score at rank 2 * rate * n (rate: label, rate)."""
    rows = placed(cells.join(rate.select("label", "rate"), "label"), keep=("rate",))
    rows = with_totals(rows, _at=F.max(F.when(F.col("rn") - 1 == F.floor(2 * F.col("rate") * F.col("n")), F.col("p"))))
    return rows.select("gene", "label", F.when(F.col("_at") > 0, F.col("p") / F.col("_at")).otherwise(F.col("p")).alias("p"))


def platt_scale(cells: DataFrame) -> DataFrame:
    """Scores (gene, label, p, a, b) through the label's sigmoid, scaled between its least and largest positive value."""
    rows = cells.withColumn("_s", sigmoid(-(F.col("a") * F.col("p") + F.col("b"))))
    rows = with_totals(rows, _low=F.min(F.when(F.col("_s") > 0, F.col("_s"))), _high=F.max("_s"))
    low, high = F.col("_low"), F.col("_high")
    return rows.select("gene", "label", F.when(high > low, (F.col("_s") - low) / (high - low)).otherwise(F.col("_s")).alias("p"))


def chop_bounds(cells: DataFrame) -> DataFrame:
    """(label, low, high) of training cells (gene, label, y, p): the least score, and the best one of a positive, 1 at most; null without a positive."""
    p = nan_to_zero(F.col("p"))
    bounds = cells.groupBy("label").agg(F.min(p).alias("low"), F.max(F.when(F.col("y") == 1, p)).alias("_high"))
    return bounds.select("label", "low", F.when(F.col("_high") > 1, 1.0).otherwise(F.col("_high")).alias("high"))


def chop_scale(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Training scores scaled so that low becomes 0 and high 1; those above are 1, labels without a positive or a range stay as they are."""
    p, span = nan_to_zero(F.col("p")), F.col("high") - F.col("low")
    rows = cells.join(bounds.select("label", "low", "high"), "label")
    return rows.select("gene", "label", F.when(span > 0, F.least((p - F.col("low")) / span, F.lit(1.0))).otherwise(p).alias("p"))


def chop_scale_unseen(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """The same for cells (gene, label, p) without labels: from their own least positive score to the training high, or their best if that is less.

    Scores below the least positive one become negative. Without a training high, the best score is 1.
    """
    rows = with_totals(cells, _low=F.min(F.when(F.col("p") > 0, F.col("p"))), _best=F.max("p")).join(bounds.select("label", "high"), "label")
    high = F.least("high", "_best")
    scaled = F.when(F.col("p") >= high, 1.0).when(high > F.col("_low"), (F.col("p") - F.col("_low")) / (high - F.col("_low")))
    return rows.select("gene", "label", F.coalesce(scaled, F.col("p")).alias("p"))


def feature_range_scale(features: DataFrame) -> DataFrame:
    """Features (gene, feature, x) of all sets together, scaled from the least positive value (0) to the largest (1) of each feature.

    Values below the least positive one stay; the least is 1 at most, and a feature of one value becomes 0.
    """
    rows = with_totals(features, ("feature",), _low=F.min(F.when(F.col("x") > 0, F.col("x"))), _high=F.max("x"))
    low, high = F.least(F.coalesce("_low", F.lit(1.0)), F.lit(1.0)), F.greatest("_high", F.lit(0.0))
    span = F.when(high > low, high - low).otherwise(1.0)
    return rows.select(*features.columns, "_low", "_high").withColumn("x", F.when(F.col("x") >= low, (F.col("x") - low) / span).otherwise(F.col("x"))).select(*features.columns)
