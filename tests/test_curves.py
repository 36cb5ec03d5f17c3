"""Thresholds and betas read off one curve, against ranking anew for each beta."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import calibration, metrics, sampling, scaling


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(7)
    rows = [(g, x, float(rng.random() < p), float(round(rng.random() ** 2, 2))) for x, p in (("a", 0.5), ("b", 0.2), ("c", 0.02), ("d", 0.0)) for g in range(80)]
    rows = [(g, x, y, min(1.0, p + 0.4 * y)) for g, x, y, p in rows]
    return spark.createDataFrame(rows, "gene long, label string, y double, p double").cache()


def test_one_curve_gives_what_ranking_for_each_beta_gives(spark, cells):
    betas = [-1.5, -0.3, 0.0, 0.8]
    table = spark.createDataFrame([(x, b) for x in "abcd" for b in betas], "label string, log_beta double")
    got = {(r["label"], r["log_beta"]): (r["precision"], r["score"], r["threshold"]) for r in metrics.thresholds_at(metrics.ag_curve(cells), table).collect()}
    for b in betas:
        for r in metrics.ag_threshold(cells, b).collect():
            assert got[r["label"], b] == pytest.approx((r["precision"], r["score"], r["threshold"]))


def test_beta_for_a_wanted_precision(spark, cells):
    curve = metrics.ag_curve(cells)
    table = spark.createDataFrame([(x, b) for x in "abcd" for b in metrics.BETAS], "label string, log_beta double")
    by = {}
    for r in metrics.thresholds_at(curve, table).collect():
        by.setdefault(r["label"], {})[r["log_beta"]] = r["precision"]
    for wanted in (0.3, 0.75, 0.999):
        for r in metrics.beta_for_precision(cells, wanted).collect():
            best, top, chosen = 0.0, 0.0, 0.0
            for b in metrics.BETAS:
                rate = by[r["label"]][b]
                if rate > best:
                    best, top = rate, b
                if rate > wanted and b > chosen:
                    chosen = b
            assert (r["log_beta"], r["precision"]) == pytest.approx((top if best < wanted else chosen, best))


def test_searched_betas_come_with_their_thresholds(spark, cells):
    some = cells.where("label < 'c'")
    found = calibration.beta_search(some, cut=1, rounds=2, rates=(1.0, 2.0), halvings=1)
    again = metrics.ag_threshold(some.join(found.select("label", "log_beta"), "label")).select("label", F.col("threshold").alias("t"))
    assert all(r["threshold"] == pytest.approx(r["t"]) for r in found.join(again, "label").collect()) and found.count() == 2


def test_quantile_normalisation_ranks_thresholds(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random((20, 4)), 1)
    p[:, 3] = 0
    t = np.array([0.5, 0.33, 1.7, 0.2])
    rows = spark.createDataFrame([(g, f"l{j}", float(p[g, j]), float(t[j])) for g in range(20) for j in range(4)], "gene long, label string, p double, t double")
    scores, thresholds = scaling.quantile_norm_thresholds(rows)
    total, ranks, at = np.zeros(21), {}, {}
    for j in range(3):
        entries = sorted([(-p[g, j], 0, g) for g in range(20)] + [(-t[j], 1, -1)])
        for k, (v, mark, g) in enumerate(entries):
            if mark:
                at[j] = k
            else:
                total[k] -= v
                ranks[g, j] = k
    total = (total - total.min()) / (total.max() - total.min())
    got = {(r["gene"], r["label"]): r["p"] for r in scores.collect()}
    assert all(got[g, f"l{j}"] == pytest.approx(total[ranks[g, j]] if j < 3 else 0) for g in range(20) for j in range(4))
    cut = {r["label"]: r["t"] for r in thresholds.collect()}
    assert all(cut[f"l{j}"] == pytest.approx(total[at[j]]) for j in range(3)) and cut["l3"] == 1.0
    assert scaling.quantile_norm_thresholds(rows.limit(0))[0].count() == 0


def test_features_of_any_set_are_refilled(spark):
    one = spark.createDataFrame([("a", "f", 1.0), ("a", "g", 2.0), ("b", "f", 3.0)], "gene string, feature string, x double")
    two = spark.createDataFrame([("c", "h", 4.0)], one.schema)
    first, second = ([tuple(r) for r in x.orderBy("gene", "feature").collect()] for x in sampling.refilled_features([one, two]))
    assert first == [("a", "f", 1.0), ("a", "g", 2.0), ("a", "h", 0.0), ("b", "f", 3.0), ("b", "h", 0.0)]
    assert second == [("c", "f", 0.0), ("c", "g", 0.0), ("c", "h", 4.0)]


def test_betas_are_averaged_over_folds_with_a_positive(spark, cells):
    some = cells.where("label IN ('a', 'd')")
    halves = [some.where("gene % 2 = 0"), some.where("gene % 2 = 1")]
    options = {"cut": 1, "rounds": 1, "rates": (1.0,), "halvings": 0}
    found = {r["label"]: r["log_beta"] for r in calibration.mean_betas(halves, **options).collect()}
    each = [{r["label"]: r["log_beta"] for r in calibration.beta_search(h, **options).collect()}["a"] for h in halves]
    assert found == {"a": pytest.approx(sum(each) / 2)}
