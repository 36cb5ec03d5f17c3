"""Calibrating scores, choosing thresholds, and correcting them by neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.functions.scalar import nan_to_zero
from labelweave.operators import metrics, scaling
from labelweave.operators.windows import with_totals


def platt_fit(cells: DataFrame, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(label, a, b) of the sigmoid 1 / (1 + exp(a p + b)), for all labels at once by Newton's method.

    A round is one aggregation by label, partial before the shuffle; labels that got worse take half
    the step again. Targets are (pos + 1) / (pos + 2) and 1 / (neg + 2).
    """
    spark = cells.sparkSession
    cells = checkpoint(cells.select("label", "y", "p"))
    counts = {r["label"]: (r["pos"], r["neg"]) for r in cells.groupBy("label").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).collect()}
    now = {x: (0.0, math.log((neg + 1) / (pos + 1))) for x, (pos, neg) in counts.items()}
    last: dict[str, tuple] = {}
    open_ = set(counts)
    for _ in range(rounds):
        if not open_:
            break
        table = spark.createDataFrame([(x, *now[x], (counts[x][0] + 1) / (counts[x][0] + 2), 1 / (counts[x][1] + 2)) for x in sorted(open_)], "label string, a double, b double, hi double, lo double")
        f = F.col("a") * F.col("p") + F.col("b")
        t = F.when(F.col("y") == 1, F.col("hi")).otherwise(F.col("lo"))
        q = 1 / (1 + F.exp(f))
        loss = F.when(f >= 0, t * f + F.log1p(F.exp(-f))).otherwise((t - 1) * f + F.log1p(F.exp(f)))
        rows = cells.join(table, "label").select("label", "p", q.alias("q"), (t - q).alias("d"), loss.alias("loss"))
        h = F.col("q") * (1 - F.col("q"))
        sums = rows.groupBy("label").agg(
            F.sum("loss").alias("loss"), F.sum(F.col("p") * F.col("d")).alias("ga"), F.sum("d").alias("gb"),
            (F.sum(F.col("p") * F.col("p") * h) + 1e-12).alias("haa"), (F.sum(h) + 1e-12).alias("hbb"), F.sum(F.col("p") * h).alias("hab"),
        ).collect()
        for r in sums:
            x = r["label"]
            if x in last and r["loss"] > last[x][0] + 1e-12 and last[x][3] > 1e-10:
                loss0, at, step, size = last[x]
                size /= 2
                last[x] = (loss0, at, step, size)
                now[x] = (at[0] + size * step[0], at[1] + size * step[1])
                continue
            if max(abs(r["ga"]), abs(r["gb"])) < tolerance:
                open_.discard(x)
                continue
            det = r["haa"] * r["hbb"] - r["hab"] ** 2
            step = (-(r["hbb"] * r["ga"] - r["hab"] * r["gb"]) / det, -(-r["hab"] * r["ga"] + r["haa"] * r["gb"]) / det)
            last[x] = (r["loss"], now[x], step, 1.0)
            now[x] = (now[x][0] + step[0], now[x][1] + step[1])
    return spark.createDataFrame([(x, *now[x]) for x in sorted(now)], "label string, a double, b double")


def platt(cells: DataFrame) -> DataFrame:
    """Cells' scores through sigmoids fitted on them, scaled to 0..1 for each label."""
    fitted = platt_fit(cells).select("label", (F.col("a")).alias("a"), "b")
    scaled = scaling.platt_scale(cells.join(fitted, "label"))
    return cells.select("gene", "label", "y").join(scaled, ["gene", "label"])


def trim(cells: DataFrame, share: float) -> DataFrame:
    """Without the scores above that at rank share * n of each label; the best one left counts as positive if none is."""
    return trim_each(cells.withColumn("share", F.lit(share))).drop("share")


def trim_each(cells: DataFrame) -> DataFrame:
    """trim() with the label's own share as a column."""
    at = scaling.placed(cells, keep=("share",)).where(F.col("rn") - 1 == F.floor(F.col("n") * F.col("share")))
    kept = cells.join(at.select("label", F.col("p").alias("_edge")), "label").where((F.col("_edge") <= 0) | (F.col("p") <= F.col("_edge")))
    rows = with_totals(kept, _most=F.max("y"), _best=F.min(F.struct(-F.col("p"), "gene")))
    lone = (F.col("_most") == 0) & (F.col("gene") == F.col("_best.gene"))
    return rows.withColumn("y", F.when(lone, 1.0).otherwise(F.col("y"))).select(*cells.columns)


def knn_recalibrate(cells: DataFrame, neighbours: DataFrame, relation: DataFrame, areas: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Scores blended with what the better half of the labels says about the label.

    cells (gene, label, y, p); neighbours (row, other); relation (k, j, positive, negative); areas
    (label, aupr). A score's own weight is the share of its gene's neighbours whose prediction at
    0.5 is right for that label.
    """
    right = ((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")
    hit = (
        neighbours.join(cells.select(F.col("gene").alias("other"), "label", right.alias("ok")), "other")
        .groupBy(F.col("row").alias("gene"), "label")
        .agg(F.avg("ok").alias("w"))
    )
    place = F.row_number().over(Window.orderBy(F.desc("aupr"), "label"))
    total = F.count("*").over(Window.partitionBy())
    best = areas.select(F.col("label").alias("k"), place.alias("_r"), total.alias("_n")).where(F.col("_r") <= F.floor(F.col("_n") * ratio) + 1)
    size = best.agg((F.count("*") - 1).alias("m"))
    said = (
        cells.select("gene", F.col("label").alias("k"), F.col("p").alias("p_k"))
        .join(best.select("k"), "k", "left_semi")
        .join(relation, "k")
        .groupBy("gene", F.col("j").alias("label"))
        .agg(F.sum(F.col("p_k") * F.col("positive") + (1 - F.col("p_k")) * F.col("negative")).alias("said"))
    )
    w = F.coalesce("w", F.lit(1.0))
    joined = cells.join(hit, ["gene", "label"], "left").join(said, ["gene", "label"], "left").join(F.broadcast(size))
    other = F.coalesce("said", F.lit(0.0)) / F.greatest("m", F.lit(1))
    return joined.select("gene", "label", "y", F.greatest(F.lit(0.0), w * F.col("p") + (1 - w) * other).alias("p"))


def best_parameters(measures: DataFrame) -> DataFrame:
    """(label, c, value): the setting with the highest mean measure of each label; NaN counts as 0, ties take the first."""
    value = nan_to_zero(F.col("value"))
    means = measures.groupBy("label", "c").agg(F.avg(value).alias("value"))
    order = Window.partitionBy("label").orderBy(F.desc("value"), "c")
    return means.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Rates that the search of betas starts from, and its moves of one label's log10 of beta; rounds of moves at most.
RATES, MOVES, ROUNDS = tuple(round(0.2 * k, 1) for k in range(1, 21)), (-0.2, -0.1, 0.1, 0.2), 51


def beta_search(cells: DataFrame, cut: int = 3, rounds: int = ROUNDS, rates=RATES, moves=MOVES, index: int = 1, halvings: int = 4) -> DataFrame:
    """(label, log_beta, threshold) whose rescaled scores have the best objective over all labels.

    First one rate for all labels, log10 beta = (precision at the optimum - 0.5) * rate: the best of a
    grid, then halfway to its neighbours, a few times. Then rounds of moves: each label's best move is found
    with the others left alone, and the better of all these moves together and the best single one is
    taken, until neither improves the objective. Cells are ranked once: thresholds of a label at any beta are
    read off its curve. All candidates of a step are evaluated in one job, side by side; there are labels x moves of them, each as large as cells.
    """
    spark = cells.sparkSession
    cells = checkpoint(cells.select("gene", "label", "y", "p"))
    curve = metrics.ag_curve(cells)
    curve = metrics.Curve(checkpoint(curve.points), checkpoint(curve.totals))
    known: dict[tuple[str, float], float] = {}  # thresholds of labels at betas, read off the curve as they are asked for

    def measured(pairs: set[tuple[str, float]]) -> dict[tuple[str, float], tuple[float, float]]:
        table = spark.createDataFrame(sorted(pairs), "label string, log_beta double")
        return {(r["label"], r["log_beta"]): (r["precision"], r["threshold"]) for r in metrics.thresholds_at(curve, table).collect()}

    precision = {x: p for (x, _), (p, _) in measured({(r["label"], 0.0) for r in curve.totals.select("label").collect()}).items()}

    def scores(candidates: list[dict[str, float]]) -> list[float]:
        asked = {(x, float(v)) for c in candidates for x, v in c.items()} - known.keys()
        known.update({pair: t for pair, (_, t) in measured(asked).items()} if asked else {})
        table = spark.createDataFrame([(k, x, known[x, float(v)]) for k, c in enumerate(candidates) for x, v in c.items()], "cand long, plain string, t double")
        each = cells.withColumnRenamed("label", "plain").join(table, "plain").withColumn("label", F.concat_ws("/", "cand", "plain"))
        soft = scaling.soft_threshold(each.select("gene", "label", "p", "t"))
        both = each.select("cand", "gene", "label", "plain", "y").join(soft, ["gene", "label"]).drop("label").withColumnRenamed("plain", "label")
        got = {r["cand"]: r["objective"] for r in metrics.objective(both, cut, index).collect()}
        return [got.get(k) if got.get(k) is not None else float("-inf") for k in range(len(candidates))]

    of_rate = lambda rate: {x: (p - 0.5) * rate for x, p in precision.items()}
    tried = dict(zip(rates, scores([of_rate(r) for r in rates]), strict=True))
    rate, step = max(tried, key=lambda r: (tried[r], -r)), abs(rates[1] - rates[0]) / 2 if len(rates) > 1 else 0
    for _ in range(halvings if step else 0):
        near = [r for r in (rate - step, rate + step) if r not in tried]
        tried |= dict(zip(near, scores([of_rate(r) for r in near]), strict=True)) if near else {}
        rate, step = max(tried, key=lambda r: (tried[r], -r)), step / 2
    now, best = of_rate(rate), tried[rate]
    for _ in range(rounds):
        singles = [(x, now[x] + m) for x in sorted(now) for m in moves]
        got = scores([now | {x: v} for x, v in singles])
        gains: dict[str, tuple[float, float]] = {}
        for (x, v), value in zip(singles, got, strict=True):
            if value > best + 1e-12 and value > gains.get(x, (best, 0.0))[0]:
                gains[x] = (value, v)
        if not gains:
            break
        single = max(gains, key=lambda x: (gains[x][0], x))
        together = now | {x: v for x, (_, v) in gains.items()}
        value = scores([together])[0] if len(gains) > 1 else float("-inf")
        now, best = (together, value) if value >= gains[single][0] else (now | {single: gains[single][1]}, gains[single][0])
    return spark.createDataFrame([(x, float(v), known[x, float(v)]) for x, v in sorted(now.items())], "label string, log_beta double, threshold double")


def mean_betas(folds: list[DataFrame], **options) -> DataFrame:
    """(label, log_beta): the mean of the betas that beta_search() finds in each fold's cells (gene, label, y, p), over the folds where the label has a positive."""
    found = None
    for cells in folds:
        betas = beta_search(cells, **options).select("label", "log_beta").join(cells.where("y = 1").select("label").distinct(), "label", "left_semi")
        found = betas if found is None else found.unionByName(betas)
    return found.groupBy("label").agg(F.avg("log_beta").alias("log_beta"))


def mean_thresholds(thresholds: DataFrame) -> DataFrame:
    """(label, t): the mean of each label's thresholds t over folds."""
    return thresholds.groupBy("label").agg(F.avg("t").alias("t"))


def labels_by_ratio(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, ratio, place): labels by predicted over actual positives, the least first; labels without positives last."""
    hits = F.sum((F.col("p") > threshold).cast("double"))
    counts = cells.groupBy("label").agg((hits / F.nullif(F.sum("y"), F.lit(0.0))).alias("ratio"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("ratio").asc_nulls_last(), "label")).cast("long"))


def best_trim(cells: DataFrame, shares=(0.0, 0.04, 0.08, 0.12, 0.16, 0.2)) -> DataFrame:
    """(label, share, mse): the share of top scores to leave out of the sigmoid's fit that gives each label the least error over all its scores."""
    parts = None
    for share in shares:
        fitted = platt_fit(trim(cells, share))
        scaled = scaling.platt_scale(cells.join(fitted, "label"))
        one = metrics.mean_squared_error(cells.select("gene", "label", "y").join(scaled, ["gene", "label"])).withColumn("share", F.lit(share))
        parts = one if parts is None else parts.unionByName(one)
    order = Window.partitionBy("label").orderBy("mse", "share")
    return parts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("label", "share", "mse")


def pseudo_labels(cells: DataFrame, positives: DataFrame) -> DataFrame:
    """cells with y = 1 for each label's n best scores (positives: label, n) and those tied with the last of them."""
    at = scaling.placed(cells.join(positives.select("label", F.col("n").alias("_n")), "label"), keep=("_n",)).where(F.col("rn") == F.col("_n"))
    rows = cells.join(positives.select("label"), "label").join(at.select("label", F.col("p").alias("_edge")), "label", "left")
    return rows.withColumn("y", F.coalesce(F.col("p") >= F.col("_edge"), F.lit(False)).cast("double")).select(*cells.columns)
