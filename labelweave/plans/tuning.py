"""Choosing settings by nested folds, and calibrated predictions with the chosen ones.

Networks are propagated once for each fold and once for the final fit. Every fold's models give scores for
the whole grid of dimensions and penalties in one pass; candidates and folds stay side by side as
columns, so calibration, thresholds and measures are one job for all of them, not one for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.functions.scalar import nan_to_zero
from labelweave.operators import calibration, metrics, models, network, priors, propagation, sampling, scaling, similarity


@dataclass(frozen=True)
class Settings:
    """How to tune. k bounds are shares of the labels; the upper end of the penalties is left out, that of k is not."""

    folds: int = 2
    k_low: float = 0.1
    k_high: float = 0.9
    k_steps: int = 1
    lam_low: float = 0.0
    lam_high: float = 0.2
    lam_steps: int = 8
    objective: int = 1
    cut: int = 3
    per_label: bool = False
    neighbours: int = 0
    auto_beta: bool = False
    log_beta: float = 0.0
    trim: bool = False
    oversample: float = 0.0
    regularised: bool = False
    refill: bool = False
    propagation: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Tuned:
    """measures (c, fold, k, lam, objective), areas (c, fold, label, aupr), chosen (label, c, k, lam), thresholds (label, a, b, log_beta, t),
    train (gene, label, y, raw, p) out of fold, predictions (gene, label, p, rank) and order (label, ratio, place)."""

    measures: DataFrame
    areas: DataFrame
    chosen: DataFrame
    thresholds: DataFrame
    train: DataFrame
    predictions: DataFrame
    order: DataFrame


def propagated(networks: list[DataFrame], labels: DataFrame, genes: DataFrame, method: str = "rwr", alpha: float = 0.2, relative: bool = False, complete: bool = False, prior: DataFrame | None = None) -> DataFrame:
    """Features (gene, net_id, label, x) of genes: labels spread over each network.

    method is "rwr" (walk with restart; `relative` divides by the walk without) or "dlp". With
    `complete`, edges that a network lacks are those of the networks' mean. With `prior`, similarities
    (src, dst, w), walks start from seeds and their most similar nodes, as many as suit each label.
    """
    if complete and len(networks) > 1:
        mean = checkpoint(network.mean_network(networks))
        networks = [checkpoint(network.overlay(edges, mean)) for edges in networks]
    scores = None
    for number, edges in enumerate(networks):
        if method == "dlp":
            p = propagation.dynamic_propagation(edges, labels, alpha)
        else:
            normal = checkpoint(network.degree_normalise(edges))
            if prior is not None:
                p = priors.walk_with_priors(normal, checkpoint(network.degrees(edges).select("node")), labels, prior, alpha=alpha, relative=relative)
            else:
                r = checkpoint(propagation.seeds(labels, network.degrees(edges)))
                p = propagation.walk(normal, r, alpha)
                if relative:
                    p = propagation.ratio(p, propagation.walk(normal, r, 1.0))
        named = p.select("node", F.lit(number).alias("net_id"), "label", "p")
        scores = named if scores is None else scores.unionByName(named)
    return propagation.feature_stack(genes, scores)


def as_features(stack: DataFrame) -> DataFrame:
    return stack.select("gene", F.concat_ws("/", F.format_string("%04d", "net_id"), "label").alias("feature"), "x")


@dataclass(frozen=True)
class _Fitted:
    """Models for labels `names` over the features `columns`."""

    names: list[str]
    columns: list[str]
    own: np.ndarray
    codes: models.Codes

    def cells(self, stack: DataFrame, truth: DataFrame, grid: list[tuple[int, int, float]]) -> DataFrame:
        """(c, gene, label, y, p) of all genes of truth (gene, label, y), for each (c, k, lam) of the grid."""
        x = models.wide(stack.join(truth.select("gene").distinct(), "gene", "left_semi"), "feature", "x", self.columns)
        y = models.wide(truth, "label", "y", self.names)
        return models.grid_cells(x.join(y, "gene"), self.names, self.own, self.codes, grid)


def _fit(stack: DataFrame, labels: DataFrame, folds: DataFrame, s: Settings) -> _Fitted:
    rows, names = models.design(stack, labels, folds)
    if s.oversample:
        rows = checkpoint(rows)
        made = sampling.synthetic_rows(rows, names, s.oversample).withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(2)))
        rows = rows.unionByName(made.select("gene", "fold", "x", "y"))
    rows = checkpoint(rows)
    columns = [r[0] for r in stack.select("feature").distinct().orderBy("feature").collect()]
    codes, (own, _) = models.fit_codes(rows, len(columns), len(names), regularised=s.regularised), models.logistic(rows, len(names), len(columns))
    return _Fitted(names, columns, own, codes)


def _keyed(cells: DataFrame) -> DataFrame:
    """Cells with candidate, fold and label as one label."""
    return cells.withColumnRenamed("label", "plain").withColumn("label", F.concat_ws("/", "c", "fold", "plain"))


def _rescaled(keyed: DataFrame, fitted: DataFrame) -> DataFrame:
    """keyed with p through the label's sigmoid (label, a, b), then rank-normalised within candidate and fold."""
    platt = keyed.drop("p").join(scaling.platt_scale(keyed.join(fitted.select("label", "a", "b"), "label")), ["gene", "label"])
    normal = scaling.quantile_norm(platt.withColumn("p", nan_to_zero(F.col("p"))), ("c", "fold"))
    return platt.drop("p").join(normal, ["c", "fold", "gene", "label"])


def tuned(networks: list[DataFrame], labels: DataFrame, test_genes: DataFrame, settings: Settings | None = None, grid: list[tuple[int, float]] | None = None) -> Tuned:
    """The whole search; `grid` (k, lam) replaces that of the settings."""
    s = settings or Settings()
    spark = labels.sparkSession
    names = [r[0] for r in labels.where("y = 1").select("label").distinct().orderBy("label").collect()]
    if not names:
        raise ValueError("no label has a positive gene")
    cut = max(1, min(s.cut, len(names) - 1))
    if grid is None:
        rows = sampling.param_grid(spark, len(names), int(s.k_low * len(names)), int(s.k_high * len(names)), s.k_steps, s.lam_low, s.lam_high, s.lam_steps).collect()
        grid = [(r["k"], r["lam"]) for r in sorted(rows, key=lambda r: r["c"])]
    numbered = [(c, int(k), float(lam)) for c, (k, lam) in enumerate(grid)]
    table = spark.createDataFrame(numbered, "c long, k long, lam double")

    dealt = checkpoint(sampling.stratified_folds(labels, s.folds))
    genes, raw = labels.select("gene").distinct(), None
    everyone = genes.unionByName(test_genes.select("gene")).distinct()
    helds = [labels.join(dealt.where(F.col("fold") == number).select("gene"), "gene", "left_semi") for number in range(s.folds)]
    seens = [checkpoint(labels.join(held.select("gene").distinct(), "gene", "left_anti")) for held in helds]
    spread = [(seen, genes) for seen in seens] + [(labels, everyone)]
    # A label with too few seeds in one fold is a feature in none, or one of zeros there.
    even = sampling.refilled_features if s.refill else sampling.consistent_features
    *stacks, last = even([checkpoint(as_features(propagated(networks, seen, some, **s.propagation))) for seen, some in spread])
    if last.isEmpty():
        raise ValueError("no label has seeds enough in every fold; take fewer folds")
    for number, (held, seen, stack) in enumerate(zip(helds, seens, stacks, strict=True)):
        fitted = _fit(stack, seen, sampling.stratified_folds(seen, 2), s)
        cells = checkpoint(fitted.cells(stack, held, numbered).withColumn("fold", F.lit(number).cast("long")))
        raw = cells if raw is None else raw.unionByName(cells)

    keyed = checkpoint(_keyed(raw))
    flat = checkpoint(_rescaled(keyed, calibration.platt_fit(keyed)))
    found = metrics.ag_threshold(flat, s.log_beta).select("label", F.col("threshold").alias("t"))
    soft = checkpoint(flat.drop("p").join(scaling.soft_threshold(flat.join(found, "label")), ["gene", "label"]))
    cand = soft.select(F.concat_ws("/", "c", "fold").alias("cand"), "gene", F.col("plain").alias("label"), "y", "p")
    split = lambda column: (F.split(column, "/")[0].cast("long").alias("c"), F.split(column, "/")[1].cast("long").alias("fold"))
    measures = checkpoint(metrics.objective(cand, cut, s.objective).select(*split("cand"), "objective").join(table, "c").select("c", "fold", "k", "lam", "objective"))
    plain = soft.select("label", "plain").distinct()
    areas = checkpoint(metrics.aupr(soft).join(plain, "label").select(*split("label"), F.col("plain").alias("label"), "aupr"))

    if s.per_label:
        best = calibration.best_parameters(areas.withColumnRenamed("aupr", "value")).select("label", "c")
    else:
        means = measures.groupBy("c").agg(F.avg(nan_to_zero(F.col("objective"))).alias("value"))
        top = means.orderBy(F.desc("value"), "c").first()["c"]
        best = spark.createDataFrame([(x, top) for x in names], "label string, c long")
    chosen = checkpoint(best.join(table, "c").select("label", "c", "k", "lam"))

    # Pooled scores of the chosen settings, each gene predicted by models that saw none of its labels.
    pooled = checkpoint(raw.join(chosen.select("c", "label"), ["c", "label"], "left_semi").select("gene", "label", "y", "p", "fold"))
    dealt_scores, pooled = pooled, pooled.drop("fold")
    trimmed = pooled
    if s.trim:
        share = calibration.best_trim(pooled).select("label", "share")
        trimmed = calibration.trim_each(pooled.join(share, "label")).drop("share")
    ab = checkpoint(calibration.platt_fit(trimmed))
    whole = lambda cells: _rescaled(cells.withColumns({"c": F.lit(0), "fold": F.lit(0)}), ab).drop("c", "fold")
    flat = checkpoint(whole(pooled))
    if s.auto_beta and s.per_label:
        parts = [checkpoint(whole(dealt_scores.where(F.col("fold") == number).drop("fold")).select("gene", "label", "y", "p")) for number in range(s.folds)]
        betas = calibration.mean_betas([part for part in parts if not part.where("y = 1").isEmpty()], cut=cut, index=s.objective)
        betas = checkpoint(flat.select("label").distinct().join(betas, "label", "left").select("label", F.coalesce("log_beta", F.lit(s.log_beta)).alias("log_beta")))
        found = betas.join(metrics.ag_threshold(flat.join(betas, "label")).select("label", F.col("threshold").alias("t")), "label")
    elif s.auto_beta:
        found = calibration.beta_search(flat, cut, index=s.objective).withColumnRenamed("threshold", "t")
    else:
        found = metrics.ag_threshold(flat, s.log_beta).select("label", F.lit(s.log_beta).alias("log_beta"), F.col("threshold").alias("t"))
    found = checkpoint(found)
    at = found.select("label", "t")
    train = checkpoint(flat.drop("p").join(scaling.soft_threshold(flat.join(at, "label")), ["gene", "label"]).select("gene", "label", "y", "p"))

    fitted = _fit(last, labels, sampling.stratified_folds(labels, 2), s)
    wanted = test_genes.select("gene").distinct().withColumns({"label": F.lit(names[0]), "y": F.lit(0.0)})
    used = {r["c"] for r in chosen.select("c").distinct().collect()}
    scores = fitted.cells(last, wanted, [g for g in numbered if g[0] in used]).join(chosen.select("c", "label"), ["c", "label"], "left_semi")
    flat = whole(checkpoint(scores.select("gene", "label", "y", "p")).join(ab.select("label"), "label", "left_semi"))
    out = checkpoint(flat.drop("p").join(scaling.soft_threshold(flat.join(at, "label")), ["gene", "label"]).select("gene", "label", "y", "p"))
    if s.neighbours:
        train, out, at = _by_neighbours(last, fitted.columns, labels, train, out, s)
        found = found.drop("t").join(at, "label")
    predictions = out.select("gene", "label", nan_to_zero(F.col("p")).alias("p"))
    predictions = predictions.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("p"), "label")).cast("long"))
    train = pooled.select("gene", "label", F.col("p").alias("raw")).join(train, ["gene", "label"]).select("gene", "label", "y", "raw", "p")
    return Tuned(measures, areas, chosen, ab.join(found, "label").select("label", "a", "b", "log_beta", "t"), train, checkpoint(predictions), calibration.labels_by_ratio(train))


def _by_neighbours(stack: DataFrame, columns: list[str], labels: DataFrame, train: DataFrame, out: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and test cells corrected by their nearest training genes' out-of-fold predictions, normalised and cut anew."""
    known = train.select("gene").distinct()
    rows = checkpoint(models.wide(stack, "feature", "x", columns).withColumnRenamed("gene", "row"))
    near = similarity.hassanat_topk(rows, s.neighbours)
    near = checkpoint(near.join(known.select(F.col("gene").alias("other")), "other", "left_semi"))
    relation, areas = checkpoint(similarity.label_relationship(labels)), checkpoint(metrics.aupr(train))
    both = train.withColumn("_test", F.lit(0)).unionByName(out.join(known, "gene", "left_anti").withColumn("_test", F.lit(1)))
    fixed = calibration.knn_recalibrate(both.drop("_test"), near, relation, areas)
    tested = both.select("gene", "_test").distinct()
    sets = fixed.join(tested, "gene")
    normal = checkpoint(sets.drop("p").join(scaling.quantile_norm(sets, ("_test",)), ["_test", "gene", "label"]))
    at = checkpoint(metrics.ag_threshold(normal.where("_test = 0"), s.log_beta).select("label", F.col("threshold").alias("t")))
    soft = checkpoint(normal.drop("p").join(scaling.soft_threshold(normal.join(at, "label")), ["gene", "label"]))
    wanted = out.select("gene").distinct()
    return soft.where("_test = 0").select("gene", "label", "y", "p"), soft.join(wanted, "gene", "left_semi").select("gene", "label", "y", "p"), at
