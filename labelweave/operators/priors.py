"""Walks that start from seeds and from nodes similar to them, with the number of similar nodes chosen for each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.operators import metrics, propagation, scaling
from labelweave.operators.windows import with_totals

#: Ranks of similarity that are tried.
RANKS = tuple(range(0, 100, 5))


def _marks(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): positives in the network of labels with two or more of them."""
    return propagation.seeds(labels, nodes).select("node", "label")


def _unit(r: DataFrame) -> DataFrame:
    """(node, label, r) with r summing to 1 for each label."""
    return with_totals(r, _sum=F.sum("r")).select("node", "label", (F.col("r") / F.col("_sum")).alias("r"))


def prior_areas(normal: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: DataFrame, ranks=RANKS, alpha: float = 0.6, folds: int = 2) -> DataFrame:
    """(label, k, aupr, base): how well a walk from one fold of a label's seeds and the k most similar nodes of each finds the others.

    Folds are dealt by place in id order; areas leave the walk's own seeds out and are means over
    folds. base is the rate of positives that chance would find. All ranks, folds and labels walk
    side by side as labels of one walk. Labels with fewer than two seeds have no row.
    """
    marks = checkpoint(_marks(labels, nodes))
    dealt = scaling.placed(marks.select(F.col("node").alias("gene"), "label", F.lit(0.0).alias("p")))
    dealt = checkpoint(dealt.select(F.col("gene").alias("node"), "label", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int").alias("fold")))
    r = None
    for k in ranks:
        own = dealt.select("node", F.concat_ws("/", F.lit(k), "fold", "label").alias("label"))
        one = propagation.add_prior(nodes, similarity, own, k)
        r = one if r is None else r.unionByName(one)
    r = checkpoint(_unit(checkpoint(r)))
    scores = propagation.walk(normal, r, alpha).select(F.col("node").alias("gene"), "label", "p")
    asked = r.select("label").distinct().withColumn("_part", F.split("label", "/", 3))
    keyed = asked.select(F.col("label").alias("key"), F.col("_part")[0].cast("int").alias("k"), F.col("_part")[1].cast("int").alias("fold"), F.col("_part")[2].alias("label"))
    # Every node counts for every label, as in the features; absent scores are 0.
    stack = propagation.feature_stack(nodes.select(F.col("node").alias("gene")), scores.select(F.col("gene").alias("node"), F.lit(0).alias("net_id"), "label", "p"))
    cells = stack.select("gene", F.col("label").alias("key"), F.col("x").alias("p")).join(keyed, "key")
    truth = dealt.select(F.col("node").alias("gene"), "label", F.col("fold").alias("_own"))
    held = cells.join(truth, ["gene", "label"], "left").where(F.col("_own").isNull() | (F.col("_own") != F.col("fold")))
    found = metrics.aupr(held.select("gene", F.col("key").alias("label"), F.col("_own").isNotNull().cast("double").alias("y"), "p"))
    areas = keyed.join(found.withColumnRenamed("label", "key"), "key").groupBy("label", "k").agg(F.avg("aupr").alias("aupr"))
    size = nodes.agg(F.count("*").alias("_nodes"))
    rate = marks.groupBy("label").agg(F.count("*").alias("_n")).join(F.broadcast(size))
    return areas.join(rate, "label").select("label", "k", "aupr", (F.col("_n") / (F.col("_nodes") * folds)).alias("base"))


def best_ranks(areas: DataFrame) -> DataFrame:
    """(label, k) of the largest area, of ties the smallest k; labels that chance would serve as well have no row."""
    best = areas.groupBy("label").agg(F.max(F.struct("aupr", (-F.col("k")).alias("less"), "base")).alias("b"))
    return best.where(F.col("b.aupr") >= F.col("b.base")).select("label", (-F.col("b.less")).cast("int").alias("k"))


def walk_with_priors(normal: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: DataFrame, ranks=RANKS, alpha: float = 0.2, relative: bool = False) -> DataFrame:
    """(node, label, p) of walks from all seeds of each label and its chosen number of similar nodes; `relative` as for a plain walk."""
    chosen = checkpoint(best_ranks(prior_areas(normal, nodes, labels, similarity, ranks)))
    marks = _marks(labels, nodes)
    r = None
    for k in ranks:  # at most as many as there are ranks to try
        one = propagation.add_prior(nodes, similarity, marks.join(chosen.where(F.col("k") == k).select("label"), "label", "left_semi").select("node", "label"), k)
        r = one if r is None else r.unionByName(one)
    r = checkpoint(_unit(checkpoint(r)))
    p = propagation.walk(normal, r, alpha)
    return propagation.ratio(p, propagation.walk(normal, r, 1.0)) if relative else p
