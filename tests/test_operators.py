"""Hand-computed cases and properties; the registered queries are checked against SQL in test_queries.py."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import calibration, metrics, models, network, priors, propagation, sampling, scaling, similarity
from labelweave.plans import commands, tuning
from labelweave.sources import tsv
from labelweave.sources.tables import both_ways

#: Toy labels: twelve genes, four labels.
GENES = ["g1", "g2", "g6", "g7", "g3", "g4", "g5", "g8", "g9", "g10", "g11", "g12"]


def cells(spark, y, p, label="a"):
    return spark.createDataFrame([(k, label, float(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "gene long, label string, y double, p double")


@pytest.fixture(scope="module")
def ring(spark):
    edges = [(f"n{k}", f"n{(k + 1) % 12}", 1.0 + k % 3) for k in range(12)] + [("n0", "n6", 2.0)]
    return both_ways(spark.createDataFrame(edges, "src string, dst string, w double"))


def dense(edges, names):
    w = np.zeros((len(names), len(names)))
    for r in edges.collect():
        w[names.index(r["src"]), names.index(r["dst"])] = r["w"]
    return w


def test_degree_normalisation_and_walk(spark, ring):
    names = sorted({r["src"] for r in ring.collect()})
    w = dense(ring, names)
    d = w.sum(1)
    normal = network.degree_normalise(ring)
    assert np.allclose(dense(normal, names), w / np.sqrt(np.outer(d, d)))
    labels = spark.createDataFrame([("n0", "x", 1.0), ("n3", "x", 1.0), ("n5", "lone", 1.0), ("gone", "x", 1.0), ("n1", "x", 0.0)], "gene string, label string, y double")
    r = propagation.seeds(labels, network.degrees(ring))
    assert {x["label"] for x in r.collect()} == {"x"}
    got = {x["node"]: x["p"] for x in propagation.walk(normal, r).collect()}
    p = np.array([got.get(n, 0.0) for n in names])
    start = np.array([0.5 if n in ("n0", "n3") else 0.0 for n in names])
    assert np.abs(p - (0.2 * dense(normal, names) @ p + 0.8 * start)).sum() <= 1e-6 and (p >= 0).all()


def test_duplicate_edges_take_the_last_line(spark, tmp_path):
    (tmp_path / "net.txt").write_text("a\tb\t1\nb\ta\t3\nb\tc\tx\n")
    got = {(r["src"], r["dst"]): r["w"] for r in tsv.read_network(spark, f"file://{tmp_path}/net.txt").collect()}
    assert got == {("a", "b"): 3.0, ("b", "a"): 3.0, ("b", "c"): 0.0, ("c", "b"): 0.0}
    (tmp_path / "m.txt").write_text("gene\tl1\tl2\ng1\t1\t0\ng2\tbad\t0.5\n")
    matrix = {(r["row"], r["col"]): r["value"] for r in tsv.read_matrix(spark, f"file://{tmp_path}/m.txt").collect()}
    assert matrix == {("g1", "l1"): 1.0, ("g1", "l2"): 0.0, ("g2", "l1"): 0.0, ("g2", "l2"): 0.5}
    tsv.write_matrix(spark.createDataFrame([("g1", "l1", 0.5), ("g1", "l2", 1.0)], "row string, col string, value double"), f"file://{tmp_path}/out")
    assert "g1\t0.500000\t1.000000" in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))


def test_area_and_threshold_goldens(spark):
    one = cells(spark, [1, 0, 1, 1], [0.9, 0.8, 0.7, 0.6])
    assert metrics.aupr(one).first()["aupr"] == pytest.approx(0.513889, abs=1e-6)
    assert metrics.ag_threshold(one).first()["threshold"] == 1.0
    two = cells(spark, [1, 0, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.4, 0.2, 0.1])
    flat, steep = metrics.ag_threshold(two).first(), metrics.ag_threshold(two, 1.0).first()
    assert (flat["aupr"], flat["score"], flat["threshold"]) == (pytest.approx(0.416667, abs=1e-6), pytest.approx(0.774597, abs=1e-6), 0.7)
    assert (steep["score"], steep["threshold"]) == (pytest.approx(0.992632, abs=1e-6), 0.4)
    assert metrics.aupr(cells(spark, [1, 0, 0, 0], [0.4, 0.9, 0.2, 0.1])).first()["aupr"] == 0.5


@pytest.mark.parametrize(("cut", "want"), [(3, [1, 1, 1, 0]), (2, [1, 0, 0, 0]), (1, [1, 0, 0, 0])])
def test_top_k_is_strict(spark, cut, want):
    rows = spark.createDataFrame([(1, f"l{k}", 0.0, p) for k, p in enumerate([0.4, 0.3, 0.3, 0.1])], "gene long, label string, y double, p double")
    assert [r["b"] for r in metrics.binarise(rows, cut).orderBy("label").collect()] == want


def test_quantile_norm_golden(spark):
    table = {"a": [3, 1, 2], "b": [5, 0, 1], "c": [0, 0, 0]}
    rows = spark.createDataFrame([(k, c, float(v)) for c, vs in table.items() for k, v in enumerate(vs)], "gene long, label string, p double")
    got = {(r["label"], r["gene"]): r["p"] for r in scaling.quantile_norm(rows).collect()}
    want = {"a": [1, 0, 2 / 7], "b": [1, 0, 2 / 7], "c": [0, 0, 0]}
    assert all(got[c, k] == pytest.approx(v) for c, vs in want.items() for k, v in enumerate(vs))


def test_soft_threshold_golden(spark):
    rows = spark.createDataFrame([(k, "a", p, 0.5) for k, p in enumerate([0.25, 0.5, 1.0])] + [(9, "off", 0.7, 1.0)], "gene long, label string, p double, t double")
    assert {r["gene"]: r["p"] for r in scaling.soft_threshold(rows).collect()} == {0: 0.25, 1: 0.5, 2: 1.0, 9: 0.0}


def test_label_relationship_by_hand(spark):
    y = {"l1": {"g1", "g2", "g3"}, "l2": {"g2", "g4"}}
    rows = spark.createDataFrame([(g, name, float(g in on)) for name, on in y.items() for g in GENES], "gene string, label string, y double")
    got = {(r["k"], r["j"]): r for r in similarity.label_relationship(rows).collect()}
    r = got["l1", "l2"]
    assert (r["positive"], r["negative"], r["transition"]) == (pytest.approx(1 / 3 - 1 / 6), pytest.approx(1 / 9 - 1 / 6), pytest.approx(1 / 2))


def test_pearson_and_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity.block_pairs, "__defaults__", (7,))
    x = np.random.default_rng(1).random((30, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, x array<double>")
    want = np.corrcoef(x)
    got = {(r["row_a"], r["row_b"]): r["r"] for r in similarity.pearson_rows(rows).collect()}
    assert len(got) == 30 * 31 / 2 and all(v == pytest.approx(want[k]) for k, v in got.items())
    d = np.array([[sum(1 - (1 + min(a, b)) / (1 + max(a, b)) for a, b in zip(p, q, strict=True)) for q in x] for p in x])
    np.fill_diagonal(d, np.inf)
    near = {(r["row"], r["rank"]): r["other"] for r in similarity.hassanat_topk(rows, 3).collect()}
    assert all(near[k, j + 1] == d[k].argsort()[j] for k in range(30) for j in range(3))


def test_enhanced_network_matches_dense_algebra(spark):
    rng = np.random.default_rng(0)
    n = 24
    w = np.triu((rng.random((n, n)) < 0.5) * rng.random((n, n)), 1)
    w = w + w.T
    names = [f"n{k:02d}" for k in range(n)]
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src string, dst string, w double")
    got = dense(network.enhance(edges), names)
    eps, k = np.finfo(float).eps, 2
    m = w * n / ((w * n).sum(0) + eps)[:, None]
    m = (m + m.T) / 2
    least = np.sort(m, 1)[:, ::-1][:, k][:, None]
    m = np.where(m > least, m, 0)
    m = (m + m.T) / 2
    np.fill_diagonal(m, 1 + np.abs(m).sum(1))
    m = n * m / ((n * m).sum(0) + eps)[:, None]
    m = m / np.sqrt(m.sum(0) + eps)
    values, vectors = np.linalg.eigh(m @ m.T)
    v = np.abs(values) - eps
    m = vectors @ np.diag(0.1 * v / (1 - 0.9 * v**2)) @ vectors.T
    own = np.diag(m).copy()
    np.fill_diagonal(m, 0)
    m = w.sum(0)[:, None] * m / (1 - own)[:, None]
    m = np.triu((m + m.T) / 2, 1)
    assert np.allclose(got, np.where(m > 0, m, 0))


def test_stratified_folds_use_each_gene_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"l{j}", float(rng.random() < share)) for k in range(90) for j, share in enumerate((0.5, 0.2, 0.05))]
    labels = spark.createDataFrame(rows, "gene long, label string, y double")
    folds = {r["gene"]: r["fold"] for r in sampling.stratified_folds(labels, 3).collect()}
    assert len(folds) == sampling.stratified_folds(labels, 3).count() <= 90
    for j in range(3):
        counts = [sum(y for g, name, y in rows if name == f"l{j}" and folds.get(g) == f) for f in range(3)]
        assert max(counts) - min(counts) <= 2


def _rows(spark, n=80, d=4, q=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=(d, q)) + rng.normal(size=(n, q)) > 0).astype(float)
    return x, y, spark.createDataFrame([(k, k % 2, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "gene long, fold long, x array<double>, y array<double>")


def test_models_match_dense_solutions(spark):
    x, y, rows = _rows(spark)
    m = np.c_[np.ones(len(x)), x]
    own, penalty = models.logistic(rows, 3, 4)
    for j in range(3):
        c, w = 1 / penalty[j], np.zeros(5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-m @ w))
            w -= np.linalg.solve(c * (m * (p * (1 - p))[:, None]).T @ m + np.eye(5), c * m.T @ (p - y[:, j]) + w)
        assert np.allclose(own[j], w, atol=1e-4)
    codes = models.ridge_codes(models.moments(rows), 4)
    z = y @ codes.projection
    for j, lam in enumerate(codes.penalties):
        assert np.allclose(codes.weights[:, j], np.linalg.solve(m.T @ m + lam * np.eye(5), m.T @ z[:, j]))
    assert models.middle_best(np.array([2, 1, 1, 1, 3.0])) == 2


def test_mean_field_follows_codes(spark):
    x, y, rows = _rows(spark, seed=3)
    codes = models.ridge_codes(models.moments(rows), 4)
    own, _ = models.logistic(rows, 3, 4)
    p = 1 / (1 + np.exp(-np.c_[np.ones(len(x)), x] @ own.T))
    assert np.allclose(models.mean_field(p, y @ codes.projection, codes.projection, codes.sigma, 0.0), p)
    pulled = models.mean_field(np.full_like(p, 0.5), y @ codes.projection, codes.projection, np.full(3, 0.05), 1.0)
    exact = []
    for row in y:
        sets = [np.array(s) for s in itertools.product((0, 1), repeat=3)]
        exact.append(sets[int(np.argmin([((s @ codes.projection - row @ codes.projection) ** 2).sum() for s in sets]))])
    assert ((pulled > 0.5) == (np.array(exact) > 0.5)).mean() > 0.85


def test_platt_is_monotone_and_fits(spark):
    rng = np.random.default_rng(2)
    p = rng.random(300)
    y = (rng.random(300) < p).astype(float)
    fitted = calibration.platt_fit(cells(spark, y, p)).first()
    a, b = fitted["a"], fitted["b"]
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y == 1, hi, lo)
    q = 1 / (1 + np.exp(a * p + b))
    assert a < 0 and abs((p * (t - q)).sum()) < 1e-5 and abs((t - q).sum()) < 1e-5


def test_oversampling_lies_between_parents(spark):
    x, y, _ = _rows(spark, 60, seed=4)
    y[:, 2] = 0
    y[:5, 2] = 1
    rows = spark.createDataFrame([(k, np.abs(a).tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "gene long, x array<double>, y array<double>")
    made = sampling.synthetic_rows(rows, ["a", "b", "c"], ratio=0.5).collect()
    low, high = np.abs(x[:5]).min(0), np.abs(x[:5]).max(0)
    assert len(made) == int(1 + y.sum() / 3 * 0.5 - 5)
    assert all((np.array(r["x"]) >= low - 1e-9).all() and (np.array(r["x"]) <= high + 1e-9).all() and r["y"][2] == 1 for r in made)


def test_commands_end_to_end(spark, ring):
    rng = np.random.default_rng(8)
    labels = spark.createDataFrame([(f"n{k}", f"l{j}", float((k + j) % 3 == 0 or rng.random() < 0.3)) for k in range(12) for j in range(3)], "gene string, label string, y double")
    test = spark.createDataFrame([("n1",), ("n4",)], "gene string")
    out = commands.pred([ring], labels, test).predictions.collect()
    assert {(r["gene"], r["label"]) for r in out} == {(g, f"l{j}") for g in ("n1", "n4") for j in range(3)} and all(0 <= r["p"] <= 1 for r in out)
    features = commands.prop([ring], labels, test, method="dlp")
    assert features.count() == 6 and features.where(F.col("x") < 0).count() == 0


@pytest.mark.parametrize("options", [{"per_label": True, "neighbours": 2, "trim": True, "objective": 4}])
def test_tuning_end_to_end(spark, ring, options):
    rng = np.random.default_rng(8)
    labels = spark.createDataFrame([(f"n{k}", f"l{j}", float((k + j) % 3 == 0 or rng.random() < 0.3)) for k in range(12) for j in range(4)], "gene string, label string, y double")
    test = spark.createDataFrame([("n1",), ("n4",), ("n4",)], "gene string")
    got = commands.tune([ring], labels, test, tuning.Settings(lam_steps=2, **options))
    measures = got.measures.collect()
    assert {(r["c"], r["fold"]) for r in measures} == {(c, f) for c in range(len({r["c"] for r in measures})) for f in range(2)}
    chosen = {r["label"]: r["c"] for r in got.chosen.collect()}
    assert set(chosen) == {f"l{j}" for j in range(4)}
    if options.get("per_label"):
        areas = got.areas.collect()
        for label, c in chosen.items():
            mean = {x: np.mean([r["aupr"] for r in areas if (r["label"], r["c"]) == (label, x)]) for x in {r["c"] for r in areas}}
            assert mean[c] == pytest.approx(max(mean.values()))
    else:
        mean = {c: np.mean([r["objective"] for r in measures if r["c"] == c]) for c in {r["c"] for r in measures}}
        assert len(set(chosen.values())) == 1 and mean[chosen["l0"]] == pytest.approx(max(mean.values()))
    train = got.train.collect()
    assert len({(r["gene"], r["label"]) for r in train}) == len(train) and all(0 <= r["p"] <= 1 for r in train)
    out = got.predictions.collect()
    assert {(r["gene"], r["label"]) for r in out} == {(g, f"l{j}") for g in ("n1", "n4") for j in range(4)} and all(0 <= r["p"] <= 1 for r in out)
    assert {r["label"] for r in got.thresholds.collect()} == set(chosen) and got.order.count() == 4


def test_beta_search_reaches_a_local_best(spark):
    rng = np.random.default_rng(3)
    rows = [(g, f"l{j}", float(rng.random() < 0.3), round(float(rng.random()), 4)) for g in range(30) for j in range(4)]
    cells_ = spark.createDataFrame([(g, x, y, min(1.0, p + 0.4 * y)) for g, x, y, p in rows], "gene long, label string, y double, p double")
    found = {r["label"]: (r["log_beta"], r["threshold"]) for r in calibration.beta_search(cells_).collect()}

    def value(beta):
        table = spark.createDataFrame([(x, float(b)) for x, b in beta.items()], "label string, log_beta double")
        at = metrics.ag_threshold(cells_.join(table, "label")).select("label", F.col("threshold").alias("t"))
        soft = cells_.select("gene", "label", "y").join(scaling.soft_threshold(cells_.join(at, "label")), ["gene", "label"]).withColumn("cand", F.lit(0))
        return metrics.objective(soft, 3).collect()[0]["objective"], {r["label"]: r["t"] for r in at.collect()}

    best, at = value({x: b for x, (b, _) in found.items()})
    assert at == {x: pytest.approx(t) for x, (_, t) in found.items()}
    label = sorted(found)[1]
    assert all(value({x: b + m * (x == label) for x, (b, _) in found.items()})[0] <= best + 1e-9 for m in calibration.MOVES)


@pytest.mark.parametrize("index", [2, 3, 4, 5, 6])
def test_objectives_are_their_measures(spark, index):
    rng = np.random.default_rng(index)
    rows = [(c, g, f"l{j}", float(rng.random() < 0.3), round(float(rng.random()), 4)) for c in range(2) for g in range(30) for j in range(4)]
    both = spark.createDataFrame(rows, "cand long, gene long, label string, y double, p double")
    got = {r["cand"]: r["objective"] for r in metrics.objective(both, 3, index).collect()}
    for c in range(2):
        own = both.where(F.col("cand") == c).drop("cand")
        want = {2: lambda: metrics.micro_aupr(own), 3: lambda: metrics.micro_f1(own, 3).select("ag_micro_f1"), 4: lambda: metrics.cost_aupr(own), 5: lambda: metrics.cross_entropy(own), 6: lambda: metrics.cost_loss(own)}[index]().first()[0]
        assert got[c] == pytest.approx(-want if index > 4 else want)


def test_logistic_in_small_blocks_gives_the_same_models(spark):
    rng = np.random.default_rng(6)
    x = rng.random((60, 4))
    rows = spark.createDataFrame([(k, k % 2, x[k].tolist(), [float(x[k, j] + rng.random() > 1) for j in range(3)]) for k in range(60)], "gene long, fold long, x array<double>, y array<double>")
    whole, small = models.logistic(rows, 3, 4), models.logistic(rows, 3, 4, most_bytes=8 * 25 * 40)
    assert np.allclose(whole[0], small[0], atol=1e-6) and (whole[1] == small[1]).all()


def test_many_rows_of_one_combination_are_dealt_at_once(spark):
    counts = {("a",): 50_001, ("a", "b"): 7, ("b",): 1_000, (): 3}
    rows = [(f"{'+'.join(names)}{k}", x, float(x in names)) for names, n in counts.items() for k in range(n) for x in ("a", "b")]
    folds = sampling.stratified_folds(spark.createDataFrame(rows, "gene string, label string, y double"), 3)
    sizes = folds.groupBy("fold", F.regexp_replace("gene", "[0-9]+$", "").alias("set")).count().collect()
    for names, n in counts.items():
        own = [r["count"] for r in sizes if r["set"] == "+".join(names)]
        assert sum(own) == n and max(own) - min(own) <= 4


def test_trims_pseudo_labels_and_order(spark):
    rows = cells(spark, [1, 0, 1, 0, 0, 0, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05])
    assert sorted(r["p"] for r in calibration.trim(rows, 0.2).collect())[-1] == 0.7
    n = spark.createDataFrame([("a", 3)], "label string, n long")
    assert sorted(r["p"] for r in calibration.pseudo_labels(rows, n).where("y = 1").collect()) == [0.7, 0.8, 0.9]
    two = rows.unionByName(cells(spark, [1, 1], [0.9, 0.1], "b")).unionByName(cells(spark, [0], [0.9], "c"))
    assert [r["label"] for r in calibration.labels_by_ratio(two).orderBy("place").collect()] == ["b", "a", "c"]
    assert calibration.best_trim(rows).first()["share"] in (0.0, 0.04, 0.08, 0.12, 0.16, 0.2)
    at = rows.withColumn("t", F.lit(0.65))
    assert metrics.f1_with_threshold(at).first()["tp"] == 2 and metrics.accuracy_with_threshold(at).first()[0] <= 1
    assert metrics.unseeded_aupr(rows, rows.where("gene = 1")).first()["aupr"] == pytest.approx(0.5)  # from the first hit on


def test_equal_scores_are_ranked_by_gene_over_several_ranges(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("gene"),
        F.lit("a").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) == 0).cast("double").alias("y"),
        F.when(F.col("id") % 100 < 2, F.pow(F.lit(10.0), -(F.col("id") % 37) - 1)).when(F.col("id") % 100 == 3, 1.0).otherwise(0.0).alias("p"),
    )
    ranked = metrics.ranked(rows)
    assert ranked.groupBy("_range").count().agg(F.max("count")).first()[0] < n / 5
    got = ranked.orderBy("rn").toPandas()
    want = rows.toPandas().sort_values(["p", "gene"], ascending=[False, True], ignore_index=True)
    assert got["gene"].tolist() == want["gene"].tolist() and got["rn"].tolist() == list(range(1, n + 1)) and got["tp"].tolist() == want["y"].cumsum().tolist()
    place = scaling.placed(rows.select("gene", "label", "p")).orderBy("rn").toPandas()
    assert place["gene"].tolist() == want["gene"].tolist() and (place["n"] == n).all()


def test_ranks_of_scores_beyond_0_and_1_and_of_none(spark):
    scores = [2.0, 1.5, 1.0, 1.0, 0.04, 0.03125, 0.03, 1e-12, 5e-324, 0.0, 0.0, -0.5, -3.0]
    rows = cells(spark, [0] * len(scores), scores)
    assert [r["p"] for r in metrics.ranked(rows).orderBy("rn").collect()] == scores
    lost = spark.createDataFrame([(1, "a", 1.0, float("nan")), (2, "a", 0.0, None), (3, "a", 0.0, 0.5)], "gene long, label string, y double, p double")
    assert [r["gene"] for r in metrics.ranked(lost).orderBy("rn").collect()] == [3, 1, 2]
    assert metrics.ranked(rows.limit(0)).count() == 0 and scaling.quantile_norm(rows.limit(0)).count() == 0


def test_features_that_one_set_lacks_leave_all(spark):
    made = lambda names: spark.createDataFrame([("g", n, 1.0) for n in names], "gene string, feature string, x double")
    kept = sampling.consistent_features([made("abc"), made("bcd"), made("cb")])
    assert [sorted(r["feature"] for r in one.collect()) for one in kept] == [["b", "c"]] * 3
    assert [one.count() for one in sampling.consistent_features([made("a"), made("b")])] == [0, 0]


def test_chopped_scaling_without_positives_or_range(spark):
    rows = cells(spark, [0, 1, 0], [0.2, 0.6, 0.9]).unionByName(cells(spark, [0, 0], [0.3, 0.5], "none")).unionByName(cells(spark, [1, 1], [0.4, 0.4], "flat"))
    got = {(r["label"], r["gene"]): round(r["p"], 6) for r in scaling.chop_scale(rows, scaling.chop_bounds(rows)).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 1.0, ("a", 2): 1.0, ("none", 0): 0.3, ("none", 1): 0.5, ("flat", 0): 0.4, ("flat", 1): 0.4}
    unseen = cells(spark, [0, 0, 0], [0.0, 0.2, 0.4])
    assert [round(r["p"], 6) for r in scaling.chop_scale_unseen(unseen, scaling.chop_bounds(rows)).orderBy("gene").collect()] == [-1.0, 0.0, 1.0]


def test_priors_are_chosen_by_held_out_area(spark, ring):
    names = sorted({r["src"] for r in ring.collect()})
    w = dense(ring, names)
    d = w.sum(1)
    normal = w / np.sqrt(np.outer(d, d))
    marked = {"x": ["n0", "n1", "n2", "n3", "n6"], "z": ["n4", "n5", "n7"], "lone": ["n8"]}
    labels = spark.createDataFrame([(n, x, 1.0) for x, own in marked.items() for n in own], "gene string, label string, y double")
    nodes = network.degrees(ring).select("node")

    def prior(train, k):
        r = np.zeros(len(names))
        for s in train:
            edge = np.sort(w[s])[::-1]
            near = w[s] > edge[k] if k < (w[s] > 0).sum() else w[s] > 0
            r += np.where(near, w[s], 0)
        r[train] = 0
        r = r / r.max() if r.max() > 0 else r
        r[train] = 1
        return r / r.sum()

    def walk(r, alpha=0.6):
        p = r.copy()
        for _ in range(200):
            p = alpha * normal @ p + (1 - alpha) * r
        return p

    def area(p, train, rest):
        order = [i for i in sorted(range(len(names)), key=lambda i: (-round(p[i], 12), names[i])) if i not in train]
        hits = [j for j, i in enumerate(order, 1) if i in rest]
        pr = [(k + 1) / j for k, j in enumerate(hits)]
        return pr[0] if len(pr) == 1 else sum(pr[k] + pr[k + 1] for k in range(len(pr) - 1)) / 2 / len(rest)

    got = {(r["label"], r["k"]): r for r in priors.prior_areas(network.degree_normalise(ring), nodes, labels, ring, ranks=(0, 1)).collect()}
    assert set(got) == {(x, k) for x in "xz" for k in (0, 1)}
    for (x, k), r in got.items():
        own = sorted(names.index(n) for n in marked[x])
        own.sort(key=lambda i: names[i])
        want = np.mean([area(walk(prior(own[f::2], k)), own[f::2], [i for i in own if i not in own[f::2]]) for f in range(2)])
        assert r["aupr"] == pytest.approx(want, abs=1e-6) and r["base"] == pytest.approx(len(own) / 24)
    rows = spark.createDataFrame([("a", 0, 0.5, 0.1), ("a", 5, 0.5, 0.1), ("a", 10, 0.2, 0.1), ("b", 0, 0.05, 0.1)], "label string, k int, aupr double, base double")
    assert [(r["label"], r["k"]) for r in priors.best_ranks(rows).collect()] == [("a", 0)]
    p = priors.walk_with_priors(network.degree_normalise(ring), nodes, labels, ring, ranks=(0, 1)).collect()
    assert {r["label"] for r in p} <= {"x", "z"} and all(r["p"] > 0 for r in p)
