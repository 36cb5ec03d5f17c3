"""Encoding label sets into codes, fitting models for them, and decoding.

Training rows are (gene, fold, x, y): arrays of features and of 0/1 labels. Every fit needs only sums
over rows. One job gives, for each fold, the moments of [1, x, y]; ridge regression for all codes
and penalties, its cross-validated errors and the canonical correlations follow from them. Where they would take too much
memory, triangles and conjugate gradients (operators.factors) give the same. The
logistic models of labels, penalties and folds are fitted in blocks by Newton's method: each
round, tasks send one gradient and curvature for each model of a block, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators import factors

#: Penalties that both models are searched over: fifteen decades.
PENALTIES = tuple(10.0**k for k in range(-6, 9))


def design(features: DataFrame, labels: DataFrame, folds: DataFrame) -> tuple[DataFrame, list[str]]:
    """Training rows from long tables (gene, feature, x), (gene, label, y) and (gene, fold), and the labels in order."""
    names = [r[0] for r in labels.where("y = 1").select("label").distinct().orderBy("label").collect()]
    columns = [r[0] for r in features.select("feature").distinct().orderBy("feature").collect()]
    x, y = wide(features, "feature", "x", columns), wide(labels, "label", "y", names)
    return x.join(y, "gene").join(folds, "gene").select("gene", "fold", "x", "y"), names


def wide(cells: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """(gene, value) with the cells (gene, key, value) as an array in the order of `wanted`, 0 where there is none."""
    place = F.array_position(F.array(*[F.lit(n) for n in wanted]), F.col(key))
    found = cells.select("gene", place.alias("_k"), F.col(value).cast("double").alias("_v")).where("_k > 0")
    at = found.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(len(wanted)).cast("long")), lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0)))
    return cells.select("gene").distinct().join(at, "gene", "left").select("gene", filled.alias(value))


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each fold the sum over its rows of the outer product of [1, x, y]."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for fold, some in part.groupby("fold"):
                m = np.c_[np.ones(len(some)), np.stack(some["x"]), np.stack(some["y"])]
                total[fold] = total.get(fold, 0) + m.T @ m
        yield pd.DataFrame({"fold": list(total), "m": [m.tobytes() for m in total.values()]})

    sums: dict[int, np.ndarray] = {}
    for r in rows.select("fold", "x", "y").mapInPandas(add, "fold long, m binary").toLocalIterator():
        m = np.frombuffer(r["m"])
        size = int(len(m) ** 0.5)
        sums[r["fold"]] = sums.get(r["fold"], 0) + m.reshape(size, size)
    return sums


def middle_best(errors: np.ndarray) -> int:
    """Index of the least error; of ties the middle one."""
    ties = np.flatnonzero(np.abs(errors - errors.min()) <= 1e-9)
    return int(ties[(len(ties) - 1) // 2])


@dataclass(frozen=True)
class Codes:
    """Label-side projection, ridge weights for each code, and the standard error of each code."""

    projection: np.ndarray
    weights: np.ndarray
    sigma: np.ndarray
    penalties: np.ndarray


def canonical_projection(total: np.ndarray, features: int, shrink: float = 1e-6) -> np.ndarray:
    """Label-side canonical vectors, strongest first, from the moments of [1, x, y]."""
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    cxx, cyy, cxy = cov[:features, :features], cov[features:, features:], cov[:features, features:]

    def root(c):
        values, vectors = np.linalg.eigh(c + shrink * np.trace(c) / len(c) * np.eye(len(c)))
        return (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T

    left, right = root(cxx), root(cyy)
    _, _, vt = np.linalg.svd(left @ cxy @ right)
    return right @ vt.T


def ridge_codes(sums: dict[int, np.ndarray], features: int, penalties=PENALTIES, projection: np.ndarray | None = None) -> Codes:
    """Ridge regression of every code on [1, x]; the penalty by cross-validated squared error. Codes are canonical ones if no projection of the labels is given."""
    total = sum(sums.values())
    b = canonical_projection(total, features) if projection is None else projection
    d = features + 1
    errors = np.zeros((len(penalties), b.shape[1]))
    solve = lambda m, lam: np.linalg.solve(m[:d, :d] + lam * np.eye(d), m[:d, d:] @ b)
    for held in sums.values():
        for k, lam in enumerate(penalties):
            w = solve(total - held, lam) if len(sums) > 1 else solve(total, lam)
            square = np.einsum("ij,jk,ki->i", b.T, held[d:, d:], b) - 2 * (w * (held[:d, d:] @ b)).sum(0) + np.einsum("ji,jk,ki->i", w, held[:d, :d], w)
            errors[k] += square / max(held[0, 0], 1) / len(sums)
    best = [middle_best(errors[:, j]) for j in range(b.shape[1])]
    weights = np.stack([solve(total, penalties[k])[:, j] for j, k in enumerate(best)], axis=1)
    sigma = np.sqrt(np.maximum(errors[best, range(len(best))], 1e-12))
    return Codes(b, weights, sigma, np.array([penalties[k] for k in best]))


def ridge_codes_by_products(rows: DataFrame, features: int, projection: np.ndarray, penalties=PENALTIES) -> Codes:
    """ridge_codes() without moments: conjugate gradients over the rows, so that memory grows with the features' number only."""
    folds = sorted(r[0] for r in rows.select("fold").distinct().collect())
    held = [*folds, None] if len(folds) > 1 else [None]
    w = factors.shifted_ridge(rows, projection, features, tuple(penalties), held)
    number = {f: k for k, f in enumerate(folds)}
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def squares(part: pd.DataFrame) -> np.ndarray:
        """For each fold the squared errors of its rows by the weights that it is held out of, and its number of rows."""
        now = shared.value
        total = np.zeros((len(folds), len(penalties) * projection.shape[1] + 1))
        for fold, some in part.groupby("fold"):
            m, y = factors.design_block(some)
            z = y @ projection
            for k in range(len(penalties)):
                gap = z - m @ now[number[fold] if len(folds) > 1 else 0, k].T
                total[number[fold], k * z.shape[1] : (k + 1) * z.shape[1]] = (gap * gap).sum(0)
            total[number[fold], -1] = len(some)
        return total

    sums = factors.summed(rows, squares, (len(folds), len(penalties) * projection.shape[1] + 1))
    shared.destroy()
    errors = (sums[:, :-1] / np.maximum(sums[:, -1:], 1)).mean(0).reshape(len(penalties), -1)
    best = [middle_best(errors[:, j]) for j in range(projection.shape[1])]
    sigma = np.sqrt(np.maximum(errors[best, range(len(best))], 1e-12))
    return Codes(projection, np.stack([w[-1, k, j] for j, k in enumerate(best)], axis=1), sigma, np.array([penalties[k] for k in best]))


#: Bytes of moments, a table for each fold, that the driver may hold; wider rows are fitted by products.
MOMENTS = 256 << 20


def fit_codes(rows: DataFrame, features: int, labels: int, penalties=PENALTIES, regularised: bool = False, most_bytes: int = MOMENTS) -> Codes:
    """Codes of rows (fold, x, y): from moments if those of all folds fit most_bytes, else by products over the rows."""
    folds = rows.select("fold").distinct().count()
    narrow = 8 * (features + labels + 1) ** 2 * max(1, folds) <= most_bytes
    r = None if narrow and not regularised else factors.triangle(rows)
    projection = factors.regularised_projection(r, features)[0] if regularised else None
    if narrow:
        return ridge_codes(moments(rows), features, penalties, projection)
    if projection is None:
        n = rows.count()
        cov = r[1:, 1:].T @ r[1:, 1:]  # behind the column of ones: of centred rows
        projection = canonical_projection(np.block([[np.full((1, 1), float(n)), np.zeros((1, len(cov)))], [np.zeros((len(cov), 1)), cov]]), features)
    return ridge_codes_by_products(rows, features, projection, penalties)


#: Bytes of curvatures that a task and the driver hold at once; blocks of so many bytes beyond which products over rows take their place.
CURVATURES, BLOCKS = 256 << 20, 4


def logistic(rows: DataFrame, labels: int, features: int, penalties=PENALTIES, folds: int = 2, rounds: int = 30, most_bytes: int = CURVATURES) -> tuple[np.ndarray, np.ndarray]:
    """Weights of [1, x] (bias last in no special place, penalised too) and the chosen penalty for each label.

    The penalty with the least mean 1 - F1 over held-out folds is refitted on all rows. Models (label,
    penalty, fold left out) are fitted in blocks whose curvatures take most_bytes at most; a model leaves
    its block once it has settled. Beyond BLOCKS such blocks they are fitted by products instead, to the same weights.
    """
    d = features + 1
    shape = (labels, len(penalties), folds + 1)  # the last fit leaves no fold out
    w = np.zeros((int(np.prod(shape)), d))
    size = max(1, most_bytes // (8 * d * d))
    if len(w) > BLOCKS * size:
        return logistic_by_products(rows, labels, features, penalties, folds, rounds)
    for low in range(0, len(w), size):
        open_ = np.arange(low, min(low + size, len(w)))
        for _ in range(rounds):
            label, penalty, fold = np.unravel_index(open_, shape)
            move = _newton_moves(rows, w[open_], label, fold, 1.0 / np.array(penalties)[penalty])
            length = np.linalg.norm(move, axis=-1, keepdims=True)
            w[open_] -= move * np.minimum(1, 20 / np.maximum(length, 1e-12))
            open_ = open_[length[:, 0] >= 1e-6]
            if not len(open_):
                break
    w = w.reshape(*shape, d)
    score = _held_out_f1(rows, w, folds)
    best = [middle_best(1 - score[j]) for j in range(labels)]
    return np.stack([w[j, k, folds] for j, k in enumerate(best)]), np.array([penalties[k] for k in best])


#: Rows that a task multiplies with all models at once; products at most for one Newton step.
SLICE, PRODUCTS = 512, 60


def logistic_by_products(rows: DataFrame, labels: int, features: int, penalties=PENALTIES, folds: int = 2, rounds: int = 30, gram_bytes: int = MOMENTS) -> tuple[np.ndarray, np.ndarray]:
    """logistic() without curvature matrices: Newton's steps by conjugate gradients, whose products with the curvature are sums over rows.

    All models (label, penalty, fold left out) go side by side, so a job is one gradient or one product for all that still move; tasks' sums are
    added up over the cluster in pieces (factors.summed). What a job holds grows with models x features. Directions are preconditioned
    by the curvature's bound, penalty and a quarter of the rows' squares, which is one table for each fold; where that takes more than
    gram_bytes, by its diagonal. A step is solved the more exactly the nearer the end is.
    """
    d = features + 1
    shape = (labels, len(penalties), folds + 1)
    label, penalty, fold = (x.ravel() for x in np.indices(shape))
    inverse = 1.0 / np.array(penalties)[penalty]
    w = np.zeros((len(label), d))
    scale = _bound(rows, d, folds, fold, inverse, gram_bytes)
    open_ = np.arange(len(w))
    for _ in range(rounds):
        own = label[open_], fold[open_]
        gradient = inverse[open_, None] * _slopes(rows, w[open_], *own) + w[open_]
        size = np.linalg.norm(gradient, axis=1)
        move = _solved(
            lambda p, some: inverse[open_[some], None] * _curved(rows, w[open_[some]], p, fold[open_[some]]) + p,  # noqa: B023
            gradient, lambda r, some: scale(r, open_[some]), np.minimum(0.1, np.sqrt(size)) * np.minimum(size, 1.0) * 1e-1,  # noqa: B023
        )
        length = np.linalg.norm(move, axis=1, keepdims=True)
        w[open_] -= move * np.minimum(1, 20 / np.maximum(length, 1e-12))
        open_ = open_[length[:, 0] >= 1e-6]
        if not len(open_):
            break
    w = w.reshape(*shape, d)
    score = _held_out_f1(rows, w, folds)
    best = [middle_best(1 - score[j]) for j in range(labels)]
    return np.stack([w[j, k, folds] for j, k in enumerate(best)]), np.array([penalties[k] for k in best])


def _solved(product, b: np.ndarray, scale, goal: np.ndarray) -> np.ndarray:
    """x of H x = b for each row of b, to a residual of `goal`; product(p, rows) and scale(r, rows) work on some of the rows."""
    x, r = np.zeros_like(b), b.copy()
    z = scale(r, np.arange(len(b)))
    p, rz = z.copy(), (r * z).sum(1)
    for _ in range(PRODUCTS):
        some = np.flatnonzero(np.linalg.norm(r, axis=1) > goal)
        if not len(some):
            break
        through = product(p[some], some)
        step = (rz[some] / np.maximum((p[some] * through).sum(1), 1e-300))[:, None]
        x[some] += step * p[some]
        r[some] -= step * through
        z = scale(r[some], some)
        now = (r[some] * z).sum(1)
        p[some] = z + (now / np.maximum(rz[some], 1e-300))[:, None] * p[some]
        rz[some] = now
    return x


def _bound(rows: DataFrame, d: int, folds: int, fold: np.ndarray, inverse: np.ndarray, most_bytes: int):
    """A function (r, models) that divides by the bound of each model's curvature: 1 + a quarter of its rows' squares over the penalty."""
    dense = 8 * d * d * (folds + 1) <= most_bytes

    def each(part: pd.DataFrame) -> np.ndarray:
        total = np.zeros((folds, d, d) if dense else (folds, d))
        for f, some in part.groupby("fold"):
            m = np.c_[np.ones(len(some)), np.stack(some["x"])]
            total[int(f)] += m.T @ m if dense else (m * m).sum(0)
        return total

    squares = factors.summed(rows, each, (folds, d, d) if dense else (folds, d), ("fold", "x"))
    left = np.concatenate([squares.sum(0)[None] - squares, squares.sum(0)[None]])  # by the fold that is left out, the last leaves none
    if not dense:
        return lambda r, models: r / (1 + inverse[models, None] * left[fold[models]] / 4)
    spectra = [np.linalg.eigh(m) for m in left]

    def divide(r: np.ndarray, models: np.ndarray) -> np.ndarray:
        out = np.empty_like(r)
        for f, (values, vectors) in enumerate(spectra):
            own = fold[models] == f
            out[own] = (r[own] @ vectors / (1 + inverse[models[own], None] * np.maximum(values, 0) / 4)) @ vectors.T
        return out

    return divide


def _slopes(rows: DataFrame, now: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The sum over each model's rows of (probability - label) [1, x]."""
    shared = rows.sparkSession.sparkContext.broadcast((now, label, fold))

    def each(part: pd.DataFrame) -> np.ndarray:
        w, label, fold = shared.value
        total = np.zeros(w.shape)
        for low in range(0, len(part), SLICE):
            some = part.iloc[low : low + SLICE]
            m, y = factors.design_block(some)
            p = 1 / (1 + np.exp(-np.clip(m @ w.T, -40, 40)))
            total += ((p - y[:, label]) * (some["fold"].to_numpy()[:, None] != fold)).T @ m
        return total

    total = factors.summed(rows, each, now.shape)
    shared.destroy()
    return total


def _curved(rows: DataFrame, now: np.ndarray, p: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The curvature of each model at its weights, times its direction."""
    shared = rows.sparkSession.sparkContext.broadcast((now, p, fold))

    def each(part: pd.DataFrame) -> np.ndarray:
        w, p, fold = shared.value
        total = np.zeros(w.shape)
        for low in range(0, len(part), SLICE):
            some = part.iloc[low : low + SLICE]
            m = np.c_[np.ones(len(some)), np.stack(some["x"])]
            q = 1 / (1 + np.exp(-np.clip(m @ w.T, -40, 40)))
            total += (q * (1 - q) * (some["fold"].to_numpy()[:, None] != fold) * (m @ p.T)).T @ m
        return total

    total = factors.summed(rows, each, now.shape, ("fold", "x"))
    shared.destroy()
    return total


def _newton_moves(rows: DataFrame, now: np.ndarray, label: np.ndarray, fold: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Newton's step of each model (weights now, its label, the fold that it leaves out, one over its penalty): one job."""
    d = now.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(now)

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        grad, curve = np.zeros(w.shape), np.zeros((*w.shape, d))
        for part in parts:
            m, y, held = np.c_[np.ones(len(part)), np.stack(part["x"])], np.stack(part["y"]), part["fold"].to_numpy()
            p = 1 / (1 + np.exp(-np.clip(m @ w.T, -40, 40)))
            kept = held[:, None] != fold
            grad += ((p - y[:, label]) * kept).T @ m
            weight = p * (1 - p) * kept
            for k in range(len(w)):
                curve[k] += (m * weight[:, [k]]).T @ m
        yield pd.DataFrame({"grad": [grad.tobytes()], "curve": [curve.tobytes()]})

    grad, curve = np.zeros(now.shape), np.zeros((*now.shape, d))
    for r in rows.select("fold", "x", "y").mapInPandas(step, "grad binary, curve binary").toLocalIterator():
        grad += np.frombuffer(r["grad"]).reshape(now.shape)
        curve += np.frombuffer(r["curve"]).reshape(curve.shape)
    shared.destroy()
    curve *= inverse[:, None, None]
    curve += np.eye(d)
    return np.linalg.solve(curve, (inverse[:, None] * grad + now)[..., None])[..., 0]


def _held_out_f1(rows: DataFrame, w: np.ndarray, folds: int) -> np.ndarray:
    """Mean F1 over folds of each label's and penalty's model without that fold."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        total = np.zeros((3, *now.shape[:2], folds))
        for part in parts:
            m, y, fold = np.c_[np.ones(len(part)), np.stack(part["x"])], np.stack(part["y"]), part["fold"].to_numpy()
            for f in range(folds):
                some = fold == f
                hit = np.einsum("nd,lkd->lkn", m[some], now[:, :, f]) > 0
                on = (y[some].T > 0)[:, None, :]
                total[:, :, :, f] += [(hit & on).sum(2), (hit & ~on).sum(2), (~hit & on).sum(2)]
        yield pd.DataFrame({"n": [total.tobytes()]})

    tp, fp, fn = sum(np.frombuffer(r["n"]).reshape(3, *w.shape[:2], folds) for r in rows.select("fold", "x", "y").mapInPandas(count, "n binary").toLocalIterator())
    prec = np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)
    rec = np.divide(tp, tp + fn, out=np.full_like(tp, 0.5), where=tp + fn > 0)
    return np.divide(2 * prec * rec, prec + rec, out=np.zeros_like(tp), where=prec + rec > 0).mean(2)


def mean_field(p: np.ndarray, codes: np.ndarray, projection: np.ndarray, sigma: np.ndarray, lam: float, sweeps: int = 100) -> np.ndarray:
    """Label probabilities that weigh each label's own odds against the codes of the whole set.

    Coordinate ascent over labels in order, all rows at once, until no probability moves by more
    than 1e-4. lam 0 leaves the own odds alone.
    """
    p = np.clip(p, 1e-12, 1 - 1e-12)
    odds, q = np.log(p / (1 - p)), p.copy()
    pull = lam**4 / (2 * sigma**2)
    for _ in range(sweeps if lam else 0):
        before = q.copy()
        for i in range(q.shape[1]):
            b = projection[i]
            rest = q @ projection - q[:, [i]] * b
            gap = (pull * (b * b - 2 * codes * b + 2 * b * rest)).sum(1)
            q[:, i] = 1 / (1 + np.exp(-np.clip(odds[:, i] - gap, -700, 700)))
        if np.abs(q - before).max(initial=0) <= 1e-4:
            break
    return np.nan_to_num(q)


def predict(rows: DataFrame, own: np.ndarray, codes: Codes, k: int, lam: float) -> Column:
    """A column of decoded label probabilities for rows' features x."""
    shared = rows.sparkSession.sparkContext.broadcast((own, codes))

    @F.pandas_udf("array<double>")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, c = shared.value
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=object)
                continue
            m = np.c_[np.ones(len(part)), np.stack(part)]
            p = 1 / (1 + np.exp(-np.clip(m @ weights.T, -700, 700)))
            yield pd.Series(list(mean_field(p, (m @ c.weights)[:, :k], c.projection[:, :k], c.sigma[:k], lam)))

    return decode("x")


def cells_of(rows: DataFrame, labels: list[str], column: Column) -> DataFrame:
    """(gene, fold, label, y, p) from rows and a column of probabilities."""
    named = F.array(*[F.lit(n) for n in labels])
    return rows.select("gene", "fold", "y", column.alias("_p")).select("gene", "fold", F.posexplode(F.arrays_zip(named.alias("label"), F.col("y"), F.col("_p").alias("p"))).alias("_k", "c")).select(
        "gene", "fold", F.col("c.label"), F.col("c.y"), F.col("c.p")
    )


def grid_cells(rows: DataFrame, labels: list[str], own: np.ndarray, codes: Codes, grid: list[tuple[int, int, float]]) -> DataFrame:
    """(c, gene, label, y, p) of rows (gene, x, y) for every (c, k, lam) of the grid, decoded in one pass over the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((own, codes))
    most = min(len(labels), codes.projection.shape[1])

    @F.pandas_udf("array<array<double>>")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, c = shared.value
        for part in parts:
            if not len(part):
                yield pd.Series([], dtype=object)
                continue
            m = np.c_[np.ones(len(part)), np.stack(part)]
            p, z = 1 / (1 + np.exp(-np.clip(m @ weights.T, -700, 700))), m @ c.weights
            found = [mean_field(p, z[:, :k], c.projection[:, :k], c.sigma[:k], lam) for k, lam in ((min(k, most), lam) for _, k, lam in grid)]
            yield pd.Series([list(x) for x in np.stack(found, axis=1)])

    numbers, named = F.array(*[F.lit(c).cast("long") for c, _, _ in grid]), F.array(*[F.lit(n) for n in labels])
    each = rows.select("gene", "y", decode("x").alias("_p")).select("gene", "y", F.explode(F.arrays_zip(numbers.alias("c"), F.col("_p").alias("q"))).alias("g"))
    zipped = F.arrays_zip(named.alias("label"), F.col("y").alias("y"), F.col("g.q").alias("p"))
    return each.select("gene", F.col("g.c").alias("c"), F.explode(zipped).alias("e")).select("c", "gene", "e.label", "e.y", "e.p")


def encode_decode(rows: DataFrame, labels: list[str], k: int | None = None, lam: float = 0.1, folds: int = 2, penalties=PENALTIES, regularised: bool = False) -> DataFrame:
    """Fits all models on rows and decodes the same rows: (gene, fold, label, y, p)."""
    features = len(rows.select("x").first()["x"])
    codes = fit_codes(rows, features, len(labels), penalties, regularised)
    own, _ = logistic(rows, len(labels), features, penalties, folds)
    k = min(k or len(labels), features, codes.projection.shape[1])
    return cells_of(rows, labels, predict(rows, own, codes, k, lam))
