"""Registered queries over the test tables; plans.oracle has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint, stored
from labelweave.functions.scalar import nan_to_zero
from labelweave.operators import calibration, factors, metrics, models, network, priors, propagation, sampling, scaling, similarity
from labelweave.plans import oracle, tuning
from labelweave.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits: engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _edges(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(f(tables.supplier_part_edges(spark, sf_dir)))


def _cells(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: rounded(f(tables.event_cells(spark, sf_dir)), digits)


def _with_threshold(cells: DataFrame) -> DataFrame:
    return cells.join(F.broadcast(cells.groupBy("label").agg(F.round(F.avg("p"), 4).alias("t"))), "label")


def _rows(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: rounded(f(tables.embedding_rows(spark, sf_dir)), digits)


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The normalised supplier-part network and the seeds of every brand in it, each made once for all steps."""
    edges = stored(tables.supplier_part_edges(spark, sf_dir))
    return stored(network.degree_normalise(edges)), checkpoint(propagation.seeds(tables.brand_seeds(spark, sf_dir), network.degrees(edges)))


def symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_quantity").alias("w"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )
    return network.symmetric(lines, "line")


def mean_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.supplier_part_edges(spark, sf_dir, "l_quantity > 25")
    return rounded(network.overlay(own, network.mean_network([own, tables.supplier_part_edges(spark, sf_dir, "l_discount > 0.05")])))


def row_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.supplier_part_edges(spark, sf_dir)
    return rounded(network.row_scale(edges, edges.select("src").distinct().count()))


def seed_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagation.seed_availability(tables.brand_seeds(spark, sf_dir), network.degrees(tables.supplier_part_edges(spark, sf_dir)))


def rwr_unrolled3(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, r = _seeded(spark, sf_dir)
    return rounded(propagation.walk_steps(normal, r, 0.2, 3))


def rwr_ratio_unrolled3(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, r = _seeded(spark, sf_dir)
    return rounded(propagation.ratio(propagation.walk_steps(normal, r, 0.2, 3), propagation.walk_steps(normal, r, 1.0, 3)))


def rwr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, r = _seeded(spark, sf_dir)
    return rounded(propagation.walk(normal, r))


def feature_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, r = _seeded(spark, sf_dir)
    start = r.select("node", F.lit(0).alias("net_id"), "label", F.col("r").alias("p"))
    step = propagation.walk_steps(normal, r, 0.2, 1).select("node", F.lit(1).alias("net_id"), "label", "p")
    return rounded(propagation.feature_stack(tables.brand_seeds(spark, sf_dir), start.unionByName(step)))


def smooth_labels(cells: DataFrame) -> DataFrame:
    relation = similarity.label_relationship(cells)
    return propagation.smooth_labels(cells, relation.select(F.col("k").alias("src"), F.col("j").alias("dst"), F.col("transition").alias("w")))


def _transitions(cells: DataFrame) -> DataFrame:
    """(src, dst, w): the share of a label's genes that have another one."""
    return similarity.label_relationship(cells).select(F.col("j").alias("src"), F.col("k").alias("dst"), F.col("transition").alias("w"))


def label_graph_smooth(cells: DataFrame) -> DataFrame:
    return propagation.smooth_until_settled(checkpoint(cells.select("gene", "label", "p")), checkpoint(_transitions(cells)))


def two_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of users' labels walking on the network of what they do and being smoothed over the labels."""
    cells, edges = _user_network(spark, sf_dir)
    normal, nodes = checkpoint(network.degree_normalise(edges)), network.degrees(edges)
    r = checkpoint(propagation.seeds(cells.select("gene", "label", "y"), nodes))
    found = propagation.two_graphs(normal, r, checkpoint(_transitions(cells)), most=2, tolerance=0.0, walk_most=3, walk_tolerance=0.0, smooth_most=4)
    return rounded(found.where("p > 0"))


def _user_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' cells, and the network of users and event types."""
    cells = checkpoint(tables.event_cells(spark, sf_dir).withColumn("gene", F.concat(F.lit("u"), F.col("gene").cast("string"))))
    edges = tables.both_ways(cells.where("n > 0").select(F.col("gene").alias("src"), F.col("label").alias("dst"), F.col("n").alias("w")))
    return cells, checkpoint(edges)


def column_scale(cells: DataFrame) -> DataFrame:
    return scaling.column_scale(cells, cells.groupBy("label").agg(F.avg("y").alias("rate")))


def nan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("value") / F.nullif(F.col("value") - 5, F.lit(0.0))
    return rounded(tables.read(spark, sf_dir, "events").select("event_id", nan_to_zero(ratio).alias("x")))


def network_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user x event type network, denoised."""
    events = tables.read(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    counts = events.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return rounded(network.enhance(tables.both_ways(counts)))


def dynamic_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of users spread over the user x event type network."""
    cells = tables.event_cells(spark, sf_dir).withColumn("gene", F.concat(F.lit("u"), F.col("gene").cast("string")))
    edges = tables.both_ways(cells.where("n > 0").select(F.col("gene").alias("src"), F.col("label").alias("dst"), F.col("n").alias("w")))
    return rounded(propagation.dynamic_propagation(edges, cells))


def event_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Users with their scores as features and their flags as labels, in stratified folds."""
    cells = tables.event_cells(spark, sf_dir)
    rows, labels = models.design(cells.select("gene", F.col("label").alias("feature"), F.col("p").alias("x")), cells, sampling.stratified_folds(cells, 2))
    return checkpoint(rows), labels


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.encode_decode(*event_rows(spark, sf_dir)))


def encode_decode_regularised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.encode_decode(*event_rows(spark, sf_dir), regularised=True))


def canonical_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical correlations of the embeddings with their labels, plain and with a ridge on the labels, by rank."""
    table = tables.read(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    classes = [r[0] for r in table.select("label").distinct().orderBy("label").collect()]
    rows = table.select(
        F.lit(0).alias("fold"), F.col("embedding").cast("array<double>").alias("x"), F.array(*[(F.col("label") == F.lit(c)).cast("double") for c in classes]).alias("y")
    )
    width = len(rows.select("x").first()["x"])
    r = factors.triangle(checkpoint(rows))
    plain, ridge = factors.canonical_pair(r, width)[2], factors.regularised_projection(r, width)[1]
    found = [("plain", k, float(v)) for k, v in enumerate(plain)] + [("ridge", k, float(v)) for k, v in enumerate(ridge)]
    return rounded(spark.createDataFrame(found, "kind string, rank long, r double"))


def consistent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the suppliers that delivered in every line status, with what each delivered in each."""
    lines = tables.read(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey % 7 <> 0 OR l_linestatus = 'F'")
    sums = lines.groupBy("l_linestatus", F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("x"))
    sums = checkpoint(sums)
    kept = sampling.consistent_features([sums.where(F.col("l_linestatus") == status) for status in ("F", "O")])
    return rounded(kept[0].unionByName(kept[1]))


def refilled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the suppliers that delivered them in either line status, zeros where a status has a supplier never."""
    lines = tables.read(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL AND (l_suppkey % 50 <> 7 OR l_linestatus = 'F')")
    sums = stored(lines.groupBy("l_linestatus", F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("feature")).agg(F.sum("l_quantity").cast("double").alias("x")))
    kept = sampling.refilled_features([sums.where(F.col("l_linestatus") == status).drop("l_linestatus") for status in ("F", "O")])
    return rounded(kept[0].withColumn("status", F.lit("F")).unionByName(kept[1].withColumn("status", F.lit("O"))))


def quantile_norm_thresholds(cells: DataFrame) -> DataFrame:
    """Scores and, as gene -1, thresholds."""
    scores, thresholds = scaling.quantile_norm_thresholds(_with_threshold(cells))
    return scores.unionByName(thresholds.select(F.lit(-1).cast("long").alias("gene"), "label", F.col("t").alias("p")))


def feature_range_scale(cells: DataFrame) -> DataFrame:
    return scaling.feature_range_scale(cells.select("gene", F.col("label").alias("feature"), F.col("n").alias("x")))


def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for rare classes of the embeddings."""
    table = tables.read(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    classes = [r[0] for r in table.select("label").distinct().orderBy("label").collect()]
    rows = table.select(
        F.col("vec_id").alias("gene"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v)).alias("x"),
        F.array(*[(F.col("label") == F.lit(c)).cast("double") for c in classes]).alias("y"),
    )
    made = sampling.synthetic_rows(checkpoint(rows), classes, ratio=1.0)
    return made.select(F.array_position("y", F.lit(1.0)).alias("first_label"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def synthetic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each class of the embeddings is given."""
    counts = synthetic_rows(spark, sf_dir).groupBy("first_label").agg(F.count("*").alias("made"))
    classes = tables.read(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("label").distinct().count()
    return spark.range(1, classes + 1).withColumnRenamed("id", "first_label").join(counts, "first_label", "left").select("first_label", F.coalesce("made", F.lit(0)).alias("made"))


def closed_form_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of the walk on the supplier network: suppliers linked by the parts that both deliver, weighed by their number."""
    lines = tables.read(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")
    one = lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("w"))
    parts = one.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "w"))).alias("e"))
    pairs = parts.select(F.posexplode("e").alias("k", "a"), "e").select("a", F.explode(F.slice("e", F.col("k") + 2, F.size("e"))).alias("b"))
    shared = checkpoint(pairs.groupBy(F.col("a.l_suppkey").alias("one"), F.col("b.l_suppkey").alias("other")).agg(F.sum(F.least("a.w", "b.w")).cast("double").alias("w")))
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    suppliers = tables.both_ways(shared.select(name("one").alias("src"), name("other").alias("dst"), "w"))
    return rounded(propagation.closed_form_walk(network.degree_normalise(suppliers)))


def prior_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' seeds with priors from the network's own weights."""
    edges = tables.supplier_part_edges(spark, sf_dir)
    nodes = network.degrees(edges).select("node")
    marks = tables.brand_seeds(spark, sf_dir).select(F.col("gene").alias("node"), "label").join(nodes, "node", "left_semi")
    return rounded(propagation.add_prior(nodes, edges, marks, 5))


def prior_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What priors from the network's own weights gain users' labels, by the number of similar nodes."""
    cells, edges = _user_network(spark, sf_dir)
    normal, nodes = checkpoint(network.degree_normalise(edges)), checkpoint(network.degrees(edges).select("node"))
    return rounded(priors.prior_areas(normal, nodes, checkpoint(cells.select("gene", "label", "y")), edges, ranks=(0, 2, 4)))


def knn_recalibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tables.event_cells(spark, sf_dir).select("gene", "label", "y", "p")
    rows = cells.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("c")).select(F.col("gene").alias("row"), F.col("c.p").alias("x"))
    found = calibration.knn_recalibrate(cells, similarity.hassanat_topk(rows, 5), similarity.label_relationship(cells), metrics.aupr(cells))
    return rounded(found)


def _objectives(cells: DataFrame, cut: int) -> DataFrame:
    """(index, objective) of the cells as they are."""
    found = [metrics.objective(cells.withColumn("cand", F.lit(k)), cut, k).select(F.col("cand").cast("long").alias("index"), F.col("objective").cast("double").alias("objective")) for k in metrics.OBJECTIVES]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def tune_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all users' labels, by settings chosen over folds; users walk on the network of what they do."""
    cells, edges = _user_network(spark, sf_dir)
    labels = cells.select("gene", "label", "y")
    found = tuning.tuned([edges], labels, labels.select("gene").distinct(), tuning.Settings(lam_steps=2, propagation={"alpha": 0.2}))
    return rounded(found.predictions)


def queries() -> dict[str, Query]:
    absolute = lambda rows: rows.select("row", F.transform("x", lambda v: F.abs(v)).alias("x"))
    return {
        "net_dnorm": _edges(network.degree_normalise),
        "net_edges_symmetric": symmetric_edges,
        "net_degree": _edges(network.degrees),
        "net_colnorm": _edges(network.column_normalise),
        "net_transition_topk": _edges(lambda e: network.transition_topk(e, 10)),
        "net_knn_prune": _edges(lambda e: network.knn_prune(e, 10)),
        "net_row_scale": row_scale,
        "net_mean_overlay": mean_overlay,
        "network_enhance": network_enhance,
        "seed_availability": seed_availability,
        "rwr_unrolled3": rwr_unrolled3,
        "rwr_ratio_unrolled3": rwr_ratio_unrolled3,
        "rwr_converged": rwr_converged,
        "dlp_propagate": dynamic_propagation,
        "feature_stack": feature_stack,
        "sois_folds": lambda spark, sf_dir: sampling.stratified_folds(tables.event_cells(spark, sf_dir), 3),
        "mlsmote": synthetic_rows,
        "mlsmote_counts": synthetic_counts,
        "encode_decode": encode_decode,
        "encode_decode_regularised": encode_decode_regularised,
        "canonical_correlations": canonical_correlations,
        "consistent_features": consistent_features,
        "refilled_features": refilled_features,
        "quantile_norm_thresholds": _cells(quantile_norm_thresholds),
        "feature_range_scale": _cells(feature_range_scale),
        "chop_scale": _cells(lambda c: scaling.chop_scale(c, scaling.chop_bounds(c))),
        "chop_scale_unseen": _cells(lambda c: scaling.chop_scale_unseen(c, scaling.chop_bounds(c.where("p < 0.5")))),
        "beta_search": _cells(calibration.beta_search),
        "tune_predict": tune_predict,
        "objectives": _cells(lambda c: _objectives(c, 3), 4),
        "f1_with_threshold": _cells(lambda c: metrics.f1_with_threshold(_with_threshold(c))),
        "accuracy_with_threshold": _cells(lambda c: metrics.accuracy_with_threshold(_with_threshold(c))),
        "over_threshold": _cells(lambda c: scaling.over_threshold(_with_threshold(c))),
        "column_max_scale": _cells(scaling.column_max_scale),
        "labels_by_ratio": _cells(calibration.labels_by_ratio),
        "pseudo_labels": _cells(lambda c: calibration.pseudo_labels(c, c.groupBy("label").agg(F.sum("y").cast("long").alias("n"))).select("gene", "label", "y")),
        "trim_scores": _cells(lambda c: calibration.trim(c.select("gene", "label", "y", "p"), 0.1)),
        "closed_form_walk": closed_form_walk,
        "prior_seeds": prior_seeds,
        "prior_areas": prior_areas,
        "platt_fit": _cells(calibration.platt),
        "knn_recalibrate": knn_recalibrate,
        "report": _cells(lambda c: metrics.report(c, 3)),
        "label_relationship": _cells(similarity.label_relationship),
        "label_graph_smooth": _cells(label_graph_smooth),
        "two_graphs_unrolled": two_graphs,
        "label_graph_smooth_unrolled": _cells(smooth_labels),
        "pearson_rows": _rows(similarity.pearson_rows),
        "pearson_columns": _rows(similarity.pearson_columns),
        "ridge_gram": _rows(lambda r: similarity.gram(r).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "s_ij"), 4),
        "hassanat_topk": _rows(lambda r: similarity.hassanat_topk(absolute(r), 5)),
        "quantile_norm": _cells(scaling.quantile_norm),
        "soft_threshold": _cells(lambda c: scaling.soft_threshold(_with_threshold(c))),
        "mask_by_threshold": _cells(lambda c: scaling.mask(_with_threshold(c))),
        "rank_scale": _cells(lambda c: scaling.rank_scale(_with_threshold(c))),
        "zscore_minmax": _cells(scaling.zscore),
        "row_max_scale": _cells(scaling.row_max_scale),
        "column_scale": _cells(column_scale),
        "platt_scale_fixed_ab": _cells(lambda c: scaling.platt_scale(c.withColumns({"a": F.lit(-2.0), "b": F.lit(0.5)}))),
        "nan_filter": nan_filter,
        "aupr_per_label": _cells(metrics.aupr),
        "aupr_micro": _cells(metrics.micro_aupr),
        "aupr_cost": _cells(metrics.cost_aupr),
        "ag_fscore_threshold": _cells(lambda c: metrics.ag_threshold(c).select("label", "score", "threshold")),
        "beta_for_precision": _cells(lambda c: metrics.beta_for_precision(c, 0.8)),
        "bin_topk": _cells(lambda c: metrics.binarise(c, 3).select("gene", "label", "b")),
        "confusion_per_label": _cells(lambda c: metrics.confusion(c, 0.5)),
        "micro_f1": _cells(lambda c: metrics.micro_f1(c, 3)),
        "accuracy_top1": _cells(metrics.accuracy),
        "topk_precision": _cells(lambda c: metrics.topk_precision(c, 10)),
        "cross_entropy": _cells(metrics.cross_entropy, 4),
        "cost_loss": _cells(metrics.cost_loss),
        "mean_squared_error": _cells(metrics.mean_squared_error),
        "label_rarity": _cells(sampling.label_rarity),
        "label_pair_counts": _cells(sampling.label_pair_counts),
        "positive_labels": _cells(lambda c: sampling.positive_labels(c.select("gene", "label", "y"))),
        "fold_modulo": _cells(lambda c: sampling.fold_modulo(c.select("gene").distinct(), 5)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
