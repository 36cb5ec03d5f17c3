"""Smoothing, two-graph propagation, triangles, canonical vectors and ridge codes by products, against numpy."""

import numpy as np
import pandas as pd
import pytest

from labelweave.operators import factors, hubs, inverse, models, network, propagation, similarity
from labelweave.plans import registry


def _smooth(p, t, alpha=0.3, tolerance=1e-3, most=100):
    """Row by row; t[j, k] is the weight from label k to label j."""
    t = t.copy()
    np.fill_diagonal(t, 0)
    out = p.copy()
    for i in range(len(p)):
        for _ in range(most):
            old = out[i].copy()
            out[i] = (1 - alpha) * p[i] + alpha / (p.shape[1] - 1) * t @ old
            if out[i].sum() == 0 or np.abs(out[i] - old).sum() / out[i].sum() <= tolerance:
                break
    return out


def _tables(spark, p, t):
    n, q = p.shape
    scores = spark.createDataFrame([(i, f"l{j}", float(p[i, j])) for i in range(n) for j in range(q) if p[i, j] or j == 0], "gene long, label string, p double")
    edges = spark.createDataFrame([(f"l{k}", f"l{j}", float(t[j, k])) for j in range(q) for k in range(q) if t[j, k]] + [("l0", "other", 9.0)], "src string, dst string, w double")
    return scores, edges


@pytest.mark.parametrize("most, every", [(100, 2), (3, 2), (100, 1)])
def test_smoothing_stops_gene_by_gene(spark, most, every):
    rng = np.random.default_rng(3)
    p, t = rng.random((25, 5)), rng.random((5, 5)) * 2.5
    p[0], p[1, 1:], p[2] = 0, 0, [0, 0, 0, 0, 1]
    t[3, 1] = 0
    scores, edges = _tables(spark, p, t)
    got = np.zeros_like(p)
    for r in propagation.smooth_until_settled(scores, edges, most=most, every=every).collect():
        got[r["gene"], int(r["label"][1:])] = r["p"]
    assert np.allclose(got, _smooth(p, t, most=most), atol=1e-12)
    assert propagation.smooth_until_settled(scores.limit(0), edges).count() == 0
    one = propagation.smooth_until_settled(scores.where("label = 'l0'"), edges).collect()
    assert all(r["p"] == pytest.approx(0.7 * p[r["gene"], 0]) for r in one)


def test_two_graphs_reach_one_fixpoint(spark):
    rng = np.random.default_rng(5)
    n, q = 14, 4
    w = np.triu((rng.random((n, n)) < 0.35) * rng.random((n, n)), 1)
    w += w.T
    w[range(n - 1), range(1, n)] = w[range(1, n), range(n - 1)] = 1
    t = rng.random((q, q))
    seeds = np.zeros((n, q))
    for j in range(q):
        seeds[rng.choice(n, 3, replace=False), j] = 1 / 3
    d = np.sqrt(w.sum(1))
    normal, r, before = w / d[:, None] / d, seeds, 0.0
    for _ in range(4):
        p = r.copy()
        for _ in range(100):
            old, p = p, 0.2 * normal @ p + 0.8 * r
            if np.abs(p - old).sum(0).max() <= 1e-9:
                break
        p = _smooth(p, t)
        if abs(p.sum() - before) <= 0.01:
            break
        before, r = p.sum(), p / p.sum(0)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", float(w[a, b])) for a in range(n) for b in range(n) if w[a, b]], "src string, dst string, w double")
    marks = spark.createDataFrame([(f"n{a}", f"l{j}", float(seeds[a, j])) for a in range(n) for j in range(q) if seeds[a, j]], "node string, label string, r double")
    _, moves = _tables(spark, p, t)
    found = propagation.two_graphs(network.degree_normalise(edges), marks, moves, walk_tolerance=1e-9)
    got = np.zeros((n, q))
    for x in found.collect():
        got[int(x["node"][1:]), int(x["label"][1:])] = x["p"]
    assert np.allclose(got, p / p.max(0), atol=1e-6)


def _rows(spark, x, y, folds=2, parts=9):
    rows = [(k % folds, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "fold long, x array<double>, y array<double>").repartition(parts)


def _data(seed, n=90, d=6, q=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (x[:, :q] + rng.normal(size=(n, q)) > 0.3).astype(float)


def test_triangle_has_the_rows_singular_values(spark):
    x, y = _data(1)
    x[:, 5] = x[:, 4] * (1 + 1e-9)
    m = np.c_[np.ones(len(x)), x, y]
    for fan in (2, 3, 8):
        r = factors.triangle(_rows(spark, x, y), fan)
        assert np.allclose(r.T @ r, m.T @ m) and np.allclose(np.linalg.svd(r)[1], np.linalg.svd(m)[1], atol=1e-9) and (np.tril(r, -1) == 0).all()
    assert factors.triangle(_rows(spark, x, y).limit(0)).shape[0] == 0


def test_ridge_projection_maximises_the_regularised_correlation(spark):
    x, y = _data(2)
    y[:, 3] = y[:, 2]  # two labels alike: the correlation lacks a rank, the codes don't
    m = np.c_[np.ones(len(x)), x]
    b, strength = factors.regularised_projection(factors.triangle(_rows(spark, x, y)), 6)
    assert b.shape == (4, 4) and strength[3] == pytest.approx(0, abs=1e-6)
    inner = y.T @ y + 0.5 * np.eye(4)
    assert np.allclose(b.T @ inner @ b, np.eye(4), atol=1e-8)
    fit = m @ np.linalg.lstsq(m, y, rcond=None)[0]
    # What [1, x] says of Y b, for b of length 1: the first vector is best of all, the others of those at right angles.
    share = lambda v: np.linalg.norm(fit @ v) / np.sqrt(v @ inner @ v)
    assert [share(v) for v in b.T[:3]] == pytest.approx(strength[:3])
    rng = np.random.default_rng(0)
    for k in range(3):
        for _ in range(200):
            v = rng.normal(size=4)
            v -= b[:, :k] @ (b[:, :k].T @ inner @ v)
            assert share(v) <= strength[k] + 1e-9
    values = np.linalg.eigvals(np.linalg.solve(inner, fit.T @ fit)).real
    assert np.allclose(np.sort(np.sqrt(np.maximum(values, 0)))[::-1], strength, atol=1e-6)


def test_canonical_pair_equals_that_of_whole_matrices(spark):
    x, y = _data(3)
    x[:, 1] = x[:, 0]
    wx, wy, s = factors.canonical_pair(factors.triangle(_rows(spark, x, y)), 6)
    m = np.c_[np.ones(len(x)), x]
    qx, qy = np.linalg.svd(m, full_matrices=False)[0][:, :6], np.linalg.qr(y)[0]
    assert np.allclose(s, np.linalg.svd(qx.T @ qy)[1], atol=1e-8)
    z = m @ wx
    assert np.allclose(z.T @ z, np.eye(4), atol=1e-8) and np.allclose(np.linalg.norm(wy, axis=0), 1)
    fitted = np.linalg.lstsq(y, z, rcond=None)[0]
    assert np.allclose(wy, fitted / np.linalg.norm(fitted, axis=0), atol=1e-8)
    for k in range(4):
        assert np.corrcoef(z[:, k], y @ wy[:, k])[0, 1] <= 1 and abs(z[:, k] @ (y @ wy[:, k])) / np.linalg.norm(y @ wy[:, k]) == pytest.approx(s[k])
    few = factors.padded(wy[:, :2])
    assert few.shape == (4, 4) and np.allclose(few[:, 2:].T @ few[:, :2], 0, atol=1e-12) and np.allclose(np.linalg.norm(few, axis=0), 1)


@pytest.mark.parametrize("folds, width", [(2, 1 << 22), (3, 20), (1, 1 << 22)])
def test_ridge_codes_by_products_equal_those_of_moments(spark, monkeypatch, folds, width):
    monkeypatch.setattr(factors, "DIRECTIONS", width)
    monkeypatch.setattr(factors, "PIECE", 5)
    x, y = _data(4)
    rows = _rows(spark, x, y, folds, 3).cache()
    want = models.ridge_codes(models.moments(rows), 6)
    got = models.ridge_codes_by_products(rows, 6, want.projection)
    assert (got.penalties == want.penalties).all() and np.allclose(got.weights, want.weights, atol=1e-7) and np.allclose(got.sigma, want.sigma, atol=1e-7)
    wide = models.fit_codes(rows, 6, 4, most_bytes=0)
    assert np.allclose(np.abs(wide.projection), np.abs(want.projection), atol=1e-6) and np.allclose(np.abs(wide.weights), np.abs(want.weights), atol=1e-6)
    assert models.fit_codes(rows, 6, 4, regularised=True).projection.shape == (4, 4)


@pytest.mark.parametrize("n, tile, panel", [(60, 16, 3), (60, 2560, 256), (1, 4, 2), (300, 64, 7)])
def test_tiles_give_every_pair_once(spark, n, tile, panel):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 11))
    if n > 2:
        x[2] = 1.0
    rows = spark.createDataFrame([(f"r{k}", v.tolist()) for k, v in enumerate(x)], "row string, x array<double>").repartition(5)
    found = similarity.pearson_rows(rows, tile, panel).collect()
    got = {(r["row_a"], r["row_b"]): r["r"] for r in found}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x) if n > 1 else np.ones((1, 1))
    assert len(found) == len(got) == n * (n + 1) // 2
    for (a, b), r in got.items():
        assert a <= b and np.allclose(r, want[int(a[1:]), int(b[1:])], equal_nan=True)
    assert similarity.pearson_rows(rows.limit(0), tile, panel).count() == 0


@pytest.mark.parametrize("gram_bytes", [1 << 20, 0])
def test_logistic_models_by_products_equal_those_by_curvature(spark, gram_bytes):
    x, y = _data(6, n=120, d=5, q=3)
    rows = _rows(spark, x, y, 2, 3).cache()
    penalties = (1e-3, 0.1, 1.0, 100.0)
    want, own = models.logistic(rows, 3, 5, penalties)
    got, chosen = models.logistic_by_products(rows, 3, 5, penalties, gram_bytes=gram_bytes)
    assert np.allclose(got, want, atol=1e-5) and (own == chosen).all()


def test_dynamic_propagation_equals_dense_kernels_and_takes_any_number_of_nodes(spark):
    rng = np.random.default_rng(4)
    n, k = 90, 10
    w = np.triu(np.where(rng.random((n, n)) < 0.2, rng.integers(1, 6, (n, n)), 0), 1).astype(float)
    w = w + w.T
    w[0], w[:, 0] = 3.0, 3.0  # a row without zeros
    names = [f"n{x:02d}" for x in range(n)]
    y = (rng.random((n, 3)) < 0.3).astype(float)
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src string, dst string, w double")
    cells = [(names[i], f"l{j}", 1.0) for i, j in zip(*np.nonzero(y), strict=True)]
    labels = spark.createDataFrame([*cells, ("n01", "lone", 1.0), ("gone", "l0", 1.0)], "gene string, label string, y double")

    def normal(m):
        d = np.sqrt(m.sum(1))
        d = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
        return m * d[:, None] * d

    def transition(at):
        least = np.sort(w, 1)[:, ::-1][:, min(at, n - 1)][:, None]
        total = np.where(w >= least, w, 0).sum(1, keepdims=True)
        return normal(np.divide(np.where(w > least, w, 0), total, out=np.zeros_like(w), where=total > 0))

    for most in (1, 4):
        p, near, now = transition(n), transition(k), y.copy()
        for _ in range(most):
            before = now.sum()
            now = 0.2 * p @ now + 0.8 * y
            p = normal(near @ (p + 0.2 * now @ now.T) @ near.T + np.eye(n))
            if abs(now.sum() - before) <= 10:
                break
        got = {(r["node"], r["label"]): r["p"] for r in propagation.dynamic_propagation(edges, labels, most=most).collect()}
        assert len(got) == n * 3
        assert all(got[names[i], f"l{j}"] == pytest.approx(now[i, j], abs=1e-12) for i in range(n) for j in range(3))
    # more nodes than a dense kernel was allowed
    users = spark.range(4100).selectExpr("concat('u', id) AS src", "concat('t', id % 5) AS dst", "CAST(1 + id % 7 AS DOUBLE) AS w", "CAST(id % 3 = 0 AS DOUBLE) AS y")
    both = users.select("src", "dst", "w").unionByName(users.selectExpr("dst AS src", "src AS dst", "w"))
    found = propagation.dynamic_propagation(both, users.selectExpr("src AS gene", "'a' AS label", "y"))
    assert found.where("p > 0").count() > 1300 and found.count() == 4105


def test_closed_form_walk_by_components_and_by_tiles(spark):
    rng = np.random.default_rng(8)
    n, names = 41, [f"n{x:02d}" for x in rng.permutation(41)]
    w = np.zeros((n, n))
    for low, high in ((0, 23), (23, 38), (38, 41)):
        w[low:high, low:high] = np.where(rng.random((high - low, high - low)) < 0.4, rng.random((high - low, high - low)), 0) + np.eye(high - low, k=1)
    w = w + w.T
    d = w.sum(1)
    w = w / np.sqrt(d[:, None] * d)
    edges = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src string, dst string, w double").repartition(3)
    want = 0.2 * np.linalg.inv(np.eye(n) - 0.8 * w)
    for dense, tile in ((100, 100), (16, 8)):
        got = {(r["src"], r["dst"]): r["w"] for r in inverse.resolvent(edges, 0.8, 0.2, dense, tile).collect()}
        assert len(got) == 23**2 + 15**2 + 3**2
        assert all(got.get((names[i], names[j]), 0.0) == pytest.approx(want[i, j], abs=1e-12) for i in range(n) for j in range(n))
    pairs = spark.range(5000).selectExpr("concat('n', id) AS src", "concat('n', id + 1 - 2 * (id % 2)) AS dst", "CAST(1 AS DOUBLE) AS w")
    assert propagation.closed_form_walk(pairs).count() == 10000  # more nodes than one task took


@pytest.mark.parametrize("hubs", [0, 1 << 22])
def test_fields_give_the_filtered_spectrum(monkeypatch, hubs):
    monkeypatch.setattr(network, "HUBS", hubs)
    monkeypatch.setattr(network, "EDGES", 50)
    rng = np.random.default_rng(3)
    n = 150
    w = np.triu((rng.random((n, n)) < 0.1) * rng.random((n, n)), 1)
    w[2] = np.r_[0, 0, 0, rng.random(n - 3)]
    w = w + w.T
    i, j = np.nonzero(w)
    fields = network.transition_fields(n, n, i, j, w[i, j])
    m = w + np.diag(1 + w.sum(1))
    m = m / m.sum(0)[:, None]
    m = m / np.sqrt(m.sum(0))
    assert np.allclose(fields.product(np.eye(n)), m @ m.T) and len(fields.hubs) == (1 if hubs else 0)
    values, vectors = np.linalg.eigh(m @ m.T)
    terms = network.chebyshev(lambda v: 0.1 * v / (1 - 0.9 * v**2))
    got = sum(c * p for c, p in zip(terms, fields.polynomials(np.arange(n), len(terms)), strict=True))
    assert np.abs(got - vectors @ np.diag(0.1 * values / (1 - 0.9 * values**2)) @ vectors.T).max() < 1e-13


def test_a_network_of_more_nodes_than_a_dense_spectrum_took(spark):
    users = spark.range(4100).selectExpr("concat('u', id) AS src", "concat('t', id % 41) AS dst", "CAST(1 + id % 7 AS DOUBLE) AS w")
    found = network.enhance(users.unionByName(users.selectExpr("dst AS src", "src AS dst", "w")))
    assert found.count() == 41 * 101 * 100 // 2  # 41 stars that no path joins


@pytest.mark.parametrize("low, near, square", [(0.0, 7, 3), (0.0, 2048, 256), (-3.0, 16, 5)])
def test_neighbours_by_screened_squares_equal_all_distances(spark, monkeypatch, low, near, square):
    monkeypatch.setattr(similarity, "NEAR", near)
    monkeypatch.setattr(similarity, "SQUARE", square)
    rng = np.random.default_rng(2)
    x = np.round(rng.random((60, 3)) * 4 + low)  # many ties, equal rows
    x[:30] += rng.random((30, 3)) * 1e-9  # told apart in double only
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, x array<double>")
    d = np.zeros((60, 60))
    for c in range(3):
        with np.errstate(all="ignore"):
            d += 1 - (1 + np.minimum(x[:, None, c], x[None, :, c])) / (1 + np.maximum(x[:, None, c], x[None, :, c]))
    got = {(r["row"], r["rank"]): r["other"] for r in similarity.hassanat_topk(rows, 4).collect()}
    want = {(i, k + 1): j for i in range(60) for k, j in enumerate([j for j in np.lexsort((np.arange(60), d[i])) if j != i and not np.isinf(d[i, j])][:4])}
    assert got == want


def test_neighbours_shuffle_no_row_per_block(spark):
    rows = spark.range(64).selectExpr("id AS row", "array(CAST(id AS DOUBLE)) AS x")
    found = similarity.block_pairs(rows, lambda pairs: (pd.DataFrame({"n": [len(a) * len(b) * (1 if one == two else 2)]}) for one, a, _, two, b, _ in pairs), "n long", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert found.groupBy().sum("n").first()[0] == 64 * 64


def test_narrow_rows_are_correlated_without_a_shuffle(spark):
    x = np.random.default_rng(6).random((50, 5))
    x[7] = 2.0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, x array<double>")
    found = similarity.pearson_rows(rows, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    with np.errstate(all="ignore"):
        want = np.corrcoef(x)
    got = {(r["row_a"], r["row_b"]): r["r"] for r in found.collect()}
    assert len(got) == 50 * 51 / 2 and all(a <= b and v == pytest.approx(want[a, b], nan_ok=True) for (a, b), v in got.items())
    wide = {(r["row_a"], r["row_b"]): r["r"] for r in similarity.pearson_rows(rows, 8, 1).collect()}  # more than four panels: by tiles
    assert wide.keys() == got.keys() and all(v == pytest.approx(got[k], nan_ok=True) for k, v in wide.items())


def test_walk_by_hubs_equals_matrix_steps(spark, monkeypatch):
    monkeypatch.setattr(hubs, "SMALL", 0)
    monkeypatch.setattr(hubs, "LABELS", 2)
    rng = np.random.default_rng(5)
    n = 60
    w = np.zeros((n, n))
    w[:4, 4:50] = np.where(rng.random((4, 46)) < 0.5, rng.random((4, 46)), 0)  # four hubs, leaves, ten nodes without an edge
    w[0, 1] = w[2, 2] = 0.3
    w = np.maximum(w, w.T)
    w[0, 10] = 0.0  # one way only
    w /= 5
    names = [f"n{k:02d}" for k in range(n)]
    normal = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src string, dst string, w double").repartition(3)
    start = np.where(rng.random((n, 3)) < 0.2, rng.random((n, 3)), 0)
    start[1, 0] = start[7, 1] = start[55, 2] = 0.5
    r = spark.createDataFrame([(names[i], f"l{j}", float(start[i, j])) for i, j in zip(*np.nonzero(start), strict=True)], "node string, label string, r double")
    network_ = hubs.Hubs.of(normal, r, ["l0", "l1", "l2"])
    assert network_.count == 4 and len(list(network_.blocks())) == 2

    def compare(found, p):
        got = {(x["node"], x["label"]): x["p"] for x in found.collect()}
        assert len(got) == (p > 0).sum() and all(v == pytest.approx(p[names.index(a), int(b[1])], abs=1e-13) for (a, b), v in got.items())

    for steps in (1, 3):
        p = start
        for _ in range(steps):
            p = 0.4 * w @ p + 0.6 * start
        compare(propagation.walk_steps(normal, r, 0.4, steps), p)
    p = np.zeros_like(start)
    for block in ([0, 1], [2]):
        new = start[:, block]
        for step in range(1, 100):
            old, new = new, 0.4 * w @ new + 0.6 * start[:, block]
            if step % 4 == 0 and np.abs(new - old).sum(0).max() <= 1e-6:
                break
        p[:, block] = new
    compare(propagation.walk(normal, r, 0.4), p)
    ring = spark.createDataFrame([(names[k], names[(k + 1) % 60], 1.0) for k in range(60)] + [("n00", names[k], 1.0) for k in range(2, 50)], "src string, dst string, w double")
    assert hubs.Hubs.of(ring, r, ["l0", "l1", "l2"]) is None  # leaves that are neighbours


def test_large_sums_are_kept_as_columns(spark):
    kept = registry.refilled_features(spark, "/root/testdata/sf0.001").inputFiles()
    assert kept and not any("/testdata/" in x for x in kept)
