"""Scores of predictions: cells (gene, label, y, p) with y 0 or 1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.operators.ranking import dealt
from labelweave.operators.windows import RUNNING



def ranked(cells: DataFrame, key: str = "label", ranges: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells with rank `rn`, running positives `tp` and running weights `w_all`, `w_pos`, and the key's totals.

    Cells are dealt once by ranges of key, score and id (ranking.dealt), so any number of equal scores is
    split; sums of the ranges give each range its start. What cells are made of is read for that
    only. cells may have a weight column `cost` (1 if it hasn't), and columns besides the known ones if
    `keep` names them.
    """
    known = dict.fromkeys(("_all", "gene", "label", "y", "p", "cost", "log_beta", "cand", *keep))
    cells = cells.select(*[c for c in known if c in cells.columns])
    cost = F.col("cost") if "cost" in cells.columns else F.lit(1.0)
    p = F.when(F.col("p").isNull() | F.isnan("p"), 0.0).otherwise(F.col("p"))
    # Ranks go from high scores to low and, among equal ones, from small genes to large.
    tie = [c for c in ("gene", "label") if c in cells.columns]
    rows = dealt(cells.withColumns({"p": p, "cost": cost}), key, F.desc("p"), *tie, ranges=ranges)
    gained = F.col("y") * F.col("cost")
    sums = rows.groupBy(key, "_range").agg(
        F.count("*").alias("_n"),
        F.sum("y").alias("_p"),
        F.sum("cost").alias("_c"),
        F.sum(gained).alias("_g"),
        F.sum((F.col("p") >= 1).cast("long")).alias("_one"),
        F.sum((F.col("p") <= 0).cast("long")).alias("_zero"),
    )
    above = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    zero = F.lit(0.0)
    starts = sums.select(
        key,
        "_range",
        *[F.coalesce(F.sum(c).over(above), zero).alias(f"{c}0") for c in ("_n", "_p", "_c", "_g")],
        *[F.sum(c).over(whole).alias(name) for c, name in (("_n", "n"), ("_p", "total"), ("_g", "gain"), ("_one", "ones"), ("_zero", "zeros"))],
    )
    run = Window.partitionBy(key, "_range").orderBy(F.desc("p"), *tie).rowsBetween(*RUNNING)
    return rows.join(starts, [key, "_range"]).select(
        *cells.columns,
        *(["cost"] if "cost" not in cells.columns else []),
        "_range",
        (F.col("_n0") + F.row_number().over(run)).alias("rn"),
        (F.col("_p0") + F.sum("y").over(run)).alias("tp"),
        (F.col("_c0") + F.sum("cost").over(run)).alias("w_all"),
        (F.col("_g0") + F.sum(gained).over(run)).alias("w_pos"),
        "n",
        "total",
        "gain",
        "ones",
        "zeros",
    )


def carried(rows: DataFrame, key: str, names: list[str], until: int = 0) -> DataFrame:
    """Ranked rows whose null values in `names` become the last ones before (until -1: strictly before) in rank order.

    Within a range of scores this is a window; each range begins with the last value of those above it.
    """
    held = rows.groupBy(key, "_range").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("rn"))).alias(n) for n in names])
    above = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(key, "_range", *[F.last(n, True).over(above).alias(f"{n}0") for n in names])
    run = Window.partitionBy(key, "_range").orderBy("rn").rowsBetween(Window.unboundedPreceding, until)
    return rows.join(starts, [key, "_range"]).withColumns({n: F.coalesce(F.last(n, True).over(run), f"{n}0") for n in names})


def _flat(cells: DataFrame) -> DataFrame:
    """All labels as one."""
    return cells.withColumn("_all", F.lit("all"))


def _area(rows: DataFrame, key: str) -> DataFrame:
    """Area under precision and recall between the first and the last hit; a single hit gives its precision.

    Consecutive hits differ in recall by one hit's share, so the trapezoids are half sums of
    precisions and need no look at the hit before.
    """
    pr, step = F.col("tp") / F.col("rn"), 1.0 / F.col("total")
    hits = rows.groupBy(key).agg(
        F.max("n").alias("n"),
        F.max("total").alias("total"),
        F.max("ones").alias("ones"),
        F.max("zeros").alias("zeros"),
        F.sum(F.when(F.col("y") == 1, pr)).alias("s"),
        F.max(F.when((F.col("y") == 1) & (F.col("tp") == 1), pr)).alias("first"),
        F.max(F.when((F.col("y") == 1) & (F.col("tp") == F.col("total")), pr)).alias("last"),
    )
    flat = (F.col("ones") > F.floor(F.col("n") * 0.99)) | (F.col("zeros") > F.floor(F.col("n") * 0.99))
    area = F.when(F.col("total") == 1, F.col("s")).otherwise((F.col("s") - (F.col("first") + F.col("last")) / 2) * step)
    return hits.select(key, F.when(flat | (F.col("total") == 0), 0.0).otherwise(area).alias("aupr"), flat.alias("flat"), (F.col("total") / F.col("n")).alias("rate"))


def aupr(cells: DataFrame) -> DataFrame:
    """(label, aupr)"""
    return _area(ranked(cells), "label").select("label", "aupr")


def micro_aupr(cells: DataFrame) -> DataFrame:
    return _area(ranked(_flat(cells), "_all"), "_all").select(F.col("aupr").alias("micro_aupr"))


@dataclass(frozen=True)
class Curve:
    """What the adjusted geometric F-measure needs of scores, whatever beta is.

    points (label, rn, p, pr, hit_pr, hit_re, miss_pr, miss_re): for each rank the precision so far, and precision and recall of
    the positives at the last hit and of the negatives at the last miss. totals (label, aupr, flat, rate, late).
    """

    points: DataFrame
    totals: DataFrame


def ag_curve(cells: DataFrame, keep: tuple[str, ...] = ()) -> Curve:
    """The curve of cells (gene, label, y, p), ranked once; `keep` names columns that points should have too."""
    rows = ranked(cells, keep=keep)
    hit, miss = F.col("y") == 1, (F.col("y") == 0) & (F.col("rn") < F.col("n"))
    tn = F.col("n") - F.col("total") - (F.col("rn") - F.col("tp"))
    measured = rows.withColumns(
        {
            "pr": F.col("tp") / F.col("rn"),
            "hit_pr": F.when(hit, F.col("tp") / F.col("rn")),
            "hit_re": F.when(hit, F.col("tp") / F.col("total")),
            "miss_pr": F.when(miss, tn / (F.col("n") - F.col("rn"))),
            "miss_re": F.when(miss, tn / (F.col("n") - F.col("total"))),
        }
    )
    sides = ["hit_pr", "hit_re", "miss_pr", "miss_re"]
    points = carried(measured, "label", sides).select("label", "rn", "p", "pr", *sides, *keep)
    late = rows.groupBy("label").agg((F.min(F.when(hit, F.col("rn"))) - 1 > F.max("total")).alias("late"))
    return Curve(points, _area(rows, "label").join(late, "label"))


def _best_points(points: DataFrame, totals: DataFrame, log: Column, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """(*by, aupr, precision, score, threshold) where the measure at log10 of beta is best, the first such rank of ties."""

    def f(squared: Column, pr: str, re: str) -> Column:
        return F.when(F.col(pr) > 0, (1 + squared) * F.col(pr) * F.col(re) / (squared * F.col(pr) + F.col(re))).otherwise(0.0)

    b, c = F.pow(F.lit(10.0), log), F.pow(F.lit(10.0), -log)
    ag = F.sqrt(f(b * b, "hit_pr", "hit_re") * f(c * c, "miss_pr", "miss_re"))
    best = points.withColumn("_ag", ag).groupBy(*by).agg(F.max(F.struct("_ag", -F.col("rn"), "p", "pr")).alias("at"))
    joined = best.join(totals, "label")
    found = (F.col("at._ag") > 0) & ~F.coalesce("late", F.lit(True)) & ~F.col("flat")
    return joined.select(
        *by,
        "aupr",
        F.when(found, F.col("at.pr")).otherwise(0.0).alias("precision"),
        F.when(found, F.col("at._ag")).otherwise(0.0).alias("score"),
        F.when(found & (F.col("aupr") >= F.col("rate")), F.col("at.p")).otherwise(1.0).alias("threshold"),
    )


def ag_threshold(cells: DataFrame, log_beta: float = 0.0) -> DataFrame:
    """(label, aupr, precision, score, threshold): the score that maximises the adjusted geometric F-measure.

    cells may have the label's log10 of beta as a column `log_beta`.

    The positive measure is that of the last hit and the negative one that of the last miss. A label
    whose first hit comes after more misses than it has positives, whose area is below its rate of
    positives, or whose scores are nearly all 0 or 1, gets threshold 1.
    """
    own = "log_beta" in cells.columns
    curve = ag_curve(cells, ("log_beta",) if own else ())
    return _best_points(curve.points, curve.totals, F.col("log_beta") if own else F.lit(log_beta))


def thresholds_at(curve: Curve, betas: DataFrame) -> DataFrame:
    """ag_threshold() for every (label, log_beta) of betas, with log_beta: no ranking, however many betas are tried."""
    return _best_points(curve.points.join(betas.select("label", "log_beta"), "label"), curve.totals, F.col("log_beta"), ("label", "log_beta"))


#: log10 of beta that beta_for_precision() tries.
BETAS = tuple(round(0.1 * k - 2, 1) for k in range(41))


def beta_for_precision(cells: DataFrame, wanted: float, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """(label, log_beta, precision): the largest beta whose best point has more than the wanted precision.

    Where no beta above 0 does, log_beta is 0; where none reaches it at all, it is the least one of those with the highest precision. precision
    is the highest that any beta gives. All betas are read off one curve in one pass.
    """
    labels = cells.select("label").distinct()
    tried = labels.withColumn("log_beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    at = thresholds_at(ag_curve(cells), tried)
    enough = F.max(F.when((F.col("precision") > wanted) & (F.col("log_beta") > 0), F.col("log_beta")))
    each = at.groupBy("label").agg(F.max("precision").alias("precision"), enough.alias("_enough"), F.max(F.struct("precision", (-F.col("log_beta")).alias("minus"))).alias("_best"))
    top = F.when(F.col("precision") > 0, -F.col("_best.minus")).otherwise(0.0)
    return each.select("label", F.when(F.col("precision") < wanted, top).otherwise(F.coalesce("_enough", F.lit(0.0))).alias("log_beta"), "precision")


def cost_aupr(cells: DataFrame) -> DataFrame:
    """Area over all cells where a positive weighs as much as its label's negatives for each positive."""
    return _cost_areas(_flat(cells), "_all").agg(F.coalesce(F.max("cost_aupr"), F.lit(0.0)).alias("cost_aupr"))


def _cost_areas(cells: DataFrame, key: str) -> DataFrame:
    """(key, cost_aupr), the costs by label within each key."""
    by = list(dict.fromkeys((key, "label")))
    totals = cells.groupBy(*by).agg(F.sum("y").alias("_pos"), F.count("*").alias("_n"))
    cost = F.when(F.col("y") == 1, (F.col("_n") - F.col("_pos")) / F.col("_pos")).otherwise(1.0)
    hits = ranked(cells.join(totals, by).withColumn("cost", cost).drop("_pos", "_n"), key).where("y = 1")
    # Half the gain of a hit times its own and the former hit's precision.
    pr = F.col("w_pos") / F.col("w_all")
    parts = carried(hits.withColumns({"_pr": pr, "_before": pr}), key, ["_before"], -1)
    return parts.groupBy(key).agg((F.sum((F.col("_pr") + F.col("_before")) * F.col("cost") / F.col("gain")) / 2).alias("cost_aupr"))


def binarise(cells: DataFrame, cut: int) -> DataFrame:
    """Cells with `b`: 1 for scores of a gene above that of rank cut (from 0), 0 for the others.

    With cut 1 and a tie at the top, the tied ones count. Genes need more labels than cut.
    """
    order = Window.partitionBy("gene").orderBy(F.desc("_v"), "label")
    whole = Window.partitionBy("gene")
    value = F.when(F.isnan("p"), 0.0).otherwise(F.col("p"))
    rows = cells.withColumn("_v", value).withColumn("_r", F.row_number().over(order))
    at = F.max(F.when(F.col("_r") == cut + 1, F.col("_v"))).over(whole)
    tied = at == F.max("_v").over(whole)
    least = F.greatest(F.when(tied, at - 0.000001).otherwise(at) if cut == 1 else at, F.lit(0.0))
    return rows.withColumn("b", F.coalesce((F.col("p") > least) & ~F.isnan("p"), F.lit(False)).cast("double")).drop("_v", "_r")


def confusion(cells: DataFrame, threshold: float, score: str = "p", key: str = "label") -> DataFrame:
    """(label, tp, fp, fn, tn, f1) at scores strictly above the threshold."""
    on, hit = F.col("y") > 0, F.col(score) > threshold
    n = lambda c: F.sum(c.cast("long"))
    counts = cells.groupBy(key).agg(n(on & hit).alias("tp"), n(~on & hit).alias("fp"), n(on & ~hit).alias("fn"), n(~on & ~hit).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") == 0, 0.5).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec)))


def micro_f1(cells: DataFrame, cut: int) -> DataFrame:
    """(micro_f1, ag_micro_f1) of the top-cut binarisation."""
    all_ = confusion(_flat(binarise(cells, cut)), 0.99, "b", "_all")
    f = lambda t, a, b: F.when(2 * F.col(t) + F.col(a) + F.col(b) > 0, 2.0 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b))).otherwise(0.0)
    plus, minus = f("tp", "fp", "fn"), f("tn", "fn", "fp")
    return all_.select(plus.alias("micro_f1"), F.sqrt(plus * minus).alias("ag_micro_f1"))


def accuracy(cells: DataFrame) -> DataFrame:
    """Right top predictions for each gene that has a positive, 1 at most."""
    top = binarise(cells, 1)
    hits, genes = F.sum(F.col("b") * F.col("y")), F.count_distinct(F.when(F.col("y") == 1, F.col("gene")))
    return top.agg(F.least(F.lit(1.0), F.when(genes > 0, hits / genes).otherwise(0.0)).alias("accuracy"))


def topk_precision(cells: DataFrame, k: int) -> DataFrame:
    """(label, precision): share of positives among the k best scores of each label."""
    return (
        ranked(cells).where(F.col("rn") <= k).groupBy("label").agg((F.sum("y") / F.count("*")).alias("precision"))
    )


def cross_entropy(cells: DataFrame) -> DataFrame:
    q = F.when(F.isnan("p"), 1e-8).otherwise(F.greatest(F.least("p", F.lit(0.99999999)), F.lit(1e-8)))
    return cells.agg((-F.sum(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("cross_entropy"))


def _losses() -> list:
    return [
        F.sum("y").alias("pos"),
        F.count("*").alias("n"),
        F.sum(((F.col("y") == 1) & ((F.col("p") < 0.5) | F.isnan("p"))).cast("double")).alias("missed"),
        F.sum(((F.col("y") == 0) & (F.col("p") > 0.5)).cast("double")).alias("wrong"),
    ]


def _loss():
    return F.when(F.col("pos") > 0, F.col("missed") * (F.col("n") - F.col("pos")) / F.col("pos")).otherwise(0.0) + F.col("wrong")


def cost_loss(cells: DataFrame) -> DataFrame:
    """Misses cost the label's negatives for each positive, false hits 1, at 0.5."""
    return cells.groupBy("label").agg(*_losses()).agg(F.sum(_loss()).alias("cost_loss"))


def mean_squared_error(cells: DataFrame) -> DataFrame:
    """(label, mse); scores of 1 or more count as right."""
    return cells.groupBy("label").agg(F.avg(F.when(F.col("p") >= 1, 0.0).otherwise(F.pow(F.col("y") - F.col("p"), 2))).alias("mse"))


def report(cells: DataFrame, cut: int) -> DataFrame:
    """One row: accuracy, micro F1, micro and macro area, their geometric mean with the AG measure."""
    f1, area = micro_f1(cells, cut), micro_aupr(cells)
    macro = aupr(cells).agg(F.avg("aupr").alias("macro_aupr"))
    joined = accuracy(cells).join(F.broadcast(f1)).join(F.broadcast(area)).join(F.broadcast(macro))
    return joined.withColumn("objective", F.sqrt(F.col("micro_aupr") * F.col("ag_micro_f1")))


def f1_with_threshold(cells: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn, f1) at scores of at least the label's threshold t."""
    return confusion(cells.withColumn("_on", (F.col("p") >= F.col("t")).cast("double")), 0.5, "_on")


def accuracy_with_threshold(cells: DataFrame) -> DataFrame:
    """accuracy() of the scores that reach their label's threshold t; the others count as 0."""
    return accuracy(cells.withColumn("p", F.when(F.col("p") >= F.col("t"), F.col("p")).otherwise(0.0)))


def unseeded_aupr(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, aupr) without the cells that seeds (gene, label) has."""
    return aupr(cells.join(seeds.select("gene", "label"), ["gene", "label"], "left_anti"))


#: What objective() can maximise, by number.
OBJECTIVES = {1: "area and counts", 2: "micro area", 3: "AG micro F1", 4: "cost area", 5: "minus cross entropy", 6: "minus cost loss"}


def objective(cells: DataFrame, cut: int, index: int = 1) -> DataFrame:
    """(cand, objective) for candidate settings side by side: cells (cand, gene, label, y, p); index as in OBJECTIVES."""
    if index not in OBJECTIVES:
        raise ValueError(f"objective {index}: one of {OBJECTIVES}")
    if index == 4:
        return _cost_areas(cells, "cand").select("cand", F.coalesce("cost_aupr", F.lit(0.0)).alias("objective"))
    if index == 5:
        q = F.when(F.isnan("p"), 1e-8).otherwise(F.greatest(F.least("p", F.lit(0.99999999)), F.lit(1e-8)))
        return cells.groupBy("cand").agg(F.sum(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q)).alias("objective"))
    if index == 6:
        counts = cells.groupBy("cand", "label").agg(*_losses())
        return counts.groupBy("cand").agg((-F.sum(_loss())).alias("objective"))
    area = _area(ranked(cells, "cand"), "cand").select("cand", "aupr")
    if index == 2:
        return area.select("cand", F.col("aupr").alias("objective"))
    top = binarise(cells.withColumn("gene", F.concat_ws("/", "cand", "gene")), cut)
    counts = confusion(top, 0.99, "b", "cand")
    f = lambda t, a, b: F.when(2 * F.col(t) + F.col(a) + F.col(b) > 0, 2.0 * F.col(t) / (2 * F.col(t) + F.col(a) + F.col(b))).otherwise(0.0)
    ag = F.sqrt(f("tp", "fp", "fn") * f("tn", "fn", "fp"))
    if index == 3:
        return counts.select("cand", ag.alias("objective"))
    return counts.join(area, "cand").select("cand", F.sqrt(F.col("aupr") * ag).alias("objective"))
