"""Factors of tall matrices whose rows are spread over tasks: triangles by a tree of blocks, canonical vectors, and least squares by products.

Rows are (fold, x, y): arrays of features and of 0/1 labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint

#: Triangles that one task of the tree folds into one; rows that a task adds to its triangle at once; share of the largest singular value below which a direction is none.
FAN, STEP, CUT = 8, 4096, 1e-6


def design_block(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """[1, x] and y of a batch of rows."""
    return np.c_[np.ones(len(part)), np.stack(part["x"])], np.stack(part["y"])


def _folded(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def triangle(rows: DataFrame, fan: int = FAN) -> np.ndarray:
    """R of [1, x, y] = Q R: every task folds its rows into one triangle, a tree folds those of `fan` tasks into one, the driver the last few.

    Singular values of R are those of the rows themselves, so nothing is squared and small ones keep their digits. Every step holds two
    triangles, as wide as [1, x, y]. Without rows it has no rows either.
    """

    def leaf(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = (np.c_[design_block(some)] for part in parts for k in range(0, len(part), STEP) for some in [part.iloc[k : k + STEP]])
        r = _folded(blocks)
        if r is not None:
            yield pd.DataFrame({"r": [r.tobytes()], "wide": [r.shape[1]]})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        r = _folded(_triangle(x, w) for x, w in zip(part["r"], part["wide"], strict=True))
        return pd.DataFrame({"id": [int(part["id"].iloc[0]) // fan], "r": [r.tobytes()], "wide": [r.shape[1]]})

    level = checkpoint(rows.select("x", "y").mapInPandas(leaf, "r binary, wide int"))
    count = level.count()
    level = level.select(F.spark_partition_id().cast("long").alias("id"), "r", "wide")
    while count > fan:
        level = checkpoint(level.groupBy(F.floor(F.col("id") / fan).alias("_g")).applyInPandas(join, "id long, r binary, wide int"))
        count, before = level.count(), count
        if count == before:  # ids that lie apart: nothing left to fold at this level
            break
    r = _folded(_triangle(x["r"], x["wide"]) for x in level.orderBy("id").toLocalIterator())
    return r if r is not None else np.zeros((0, 0))


def _triangle(data: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, wide)


def _thin(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular vectors and values of the directions that m has."""
    u, s, v = np.linalg.svd(m, full_matrices=False)
    kept = s > CUT * max(s.max(initial=0.0), 1e-300)
    return u[:, kept], s[kept], v[kept]


def regularised_projection(r: np.ndarray, features: int, ridge: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(label-side vectors, their correlations), strongest first, of the canonical correlation of [1, x] with y that adds `ridge` to Y'Y.

    With b of length 1 in Y'Y + ridge I, the correlation of Y b with what [1, x] can say is greatest, and so on for b at right angles to
    those before. r is the triangle of [1, x, y]. There is a vector for every label: where the correlation has less rank, the rest
    completes the basis at correlation 0. Signs are those that make the largest entry positive.
    """
    d = features + 1
    ux, _, _ = _thin(r[:, :d])
    y = r[:, d:]
    values, v = np.linalg.eigh(y.T @ y)
    root = (v / np.sqrt(np.maximum(values, 0) + ridge)) @ v.T
    left, s, _ = np.linalg.svd(root @ y.T @ ux, full_matrices=True)
    b = root @ left
    strength = np.zeros(b.shape[1])
    strength[: len(s)] = s
    return _signed(b), strength


def canonical_pair(r: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature-side vectors, label-side vectors, correlations) of [1, x] and y, strongest first, from their triangle.

    [1, x] times a feature-side vector has length 1; the label-side one is the least-squares fit of that, of length 1 itself. There are as many
    as correlations above CUT.
    """
    d = features + 1
    (ux, sx, vx), (uy, sy, vy) = _thin(r[:, :d]), _thin(r[:, d:])
    left, s, _ = np.linalg.svd(ux.T @ uy @ vy, full_matrices=False)
    left, s = left[:, s > CUT], s[s > CUT]
    wx = (vx.T / sx) @ left
    wy = (vy.T / sy) @ (uy.T @ (r[:, :d] @ wx))
    wy = wy / np.maximum(np.linalg.norm(wy, axis=0), 1e-300)
    sign = np.where(np.take_along_axis(wy, np.abs(wy).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return wx * sign, wy * sign, s


def _signed(w: np.ndarray) -> np.ndarray:
    return w * np.where(np.take_along_axis(w, np.abs(w).argmax(0)[None], 0) < 0, -1.0, 1.0) if w.size else w


def padded(w: np.ndarray) -> np.ndarray:
    """w with columns of length 1, at right angles to those that it has and to each other, up to as many as rows."""
    missing = w.shape[0] - w.shape[1]
    if missing <= 0:
        return w
    full, _, _ = np.linalg.svd(w, full_matrices=True)
    return np.c_[w, _signed(full[:, w.shape[1] :])]


#: Doubles that tasks add up in one piece.
PIECE = 1 << 17


def summed(rows: DataFrame, each, shape: tuple[int, ...], columns: tuple[str, ...] = ("fold", "x", "y")) -> np.ndarray:
    """The sum over batches of rows of the arrays each(batch): tasks add theirs, pieces are added up over tasks, and the driver gets one array."""
    size = int(np.prod(shape))

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in parts:
            if len(part):
                total += each(part).ravel()
        at = range(0, size, PIECE)
        yield pd.DataFrame({"piece": list(at), "v": [total[k : k + PIECE].tobytes() for k in at]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in part["v"])
        return pd.DataFrame({"piece": [part["piece"].iloc[0]], "v": [total.tobytes()]})

    out = np.zeros(size)
    for r in rows.select(*columns).mapInPandas(own, "piece long, v binary").groupBy("piece").applyInPandas(add, "piece long, v binary").toLocalIterator():
        v = np.frombuffer(r["v"])
        out[r["piece"] : r["piece"] + len(v)] = v
    return out.reshape(shape)


#: Doubles of search directions that go to the tasks in one job, and rounds at most for each unknown of a system.
DIRECTIONS, PATIENCE = 1 << 22, 4


def shifted_ridge(rows: DataFrame, targets: np.ndarray, features: int, penalties: tuple[float, ...], held: list[int | None], tolerance: float = 1e-12) -> np.ndarray:
    """Weights (held, penalty, code, [1, x]) of ridge regression of y @ targets on [1, x], for every fold that is held out (None: none).

    Conjugate gradients by products alone: a round multiplies the rows of every fold with the search directions and back, in one job for
    all codes and folds. All penalties share the directions of the least one (shifted systems have the same Krylov spaces), so
    more penalties cost no more products. Memory grows with the width of [1, x], not its square.
    """
    d, q = features + 1, targets.shape[1]
    out = np.zeros((len(held), len(penalties), q, d))
    columns = [(h, j) for h in range(len(held)) for j in range(q)]
    width = max(1, DIRECTIONS // d)
    for low in range(0, len(columns), width):
        some = columns[low : low + width]
        left_out = np.array([-1 if held[h] is None else held[h] for h, _ in some])
        own = np.array([j for _, j in some])
        b = _through(rows, None, targets[:, own], left_out, d)
        w = _shifted(lambda p: _through(rows, p, None, left_out, d), b, np.array(penalties), tolerance)  # noqa: B023
        for k, (h, j) in enumerate(some):
            out[h, :, j] = w[:, :, k]
    return out


def _through(rows: DataFrame, p: np.ndarray | None, targets: np.ndarray | None, left_out: np.ndarray, d: int) -> np.ndarray:
    """M' M p, or M' y targets, with each column over the rows of all folds but the one that it leaves out."""
    shared = rows.sparkSession.sparkContext.broadcast((p, targets, left_out))

    def each(part: pd.DataFrame) -> np.ndarray:
        p, targets, left_out = shared.value
        m, y = design_block(part)
        z = m @ p if targets is None else y @ targets
        return m.T @ (z * (part["fold"].to_numpy()[:, None] != left_out))

    total = summed(rows, each, (d, len(left_out)))
    shared.destroy()
    return total


def _shifted(product, b: np.ndarray, penalties: np.ndarray, tolerance: float) -> np.ndarray:
    """x (penalty, unknown, column) of (A + penalty) x = b for all penalties at once; product(p) is A p."""
    order = np.argsort(penalties)
    base, shifts = penalties[order[0]], penalties[order] - penalties[order[0]]
    n, columns = b.shape
    x, p = np.zeros((len(shifts), n, columns)), np.repeat(b[None], len(shifts), 0)
    r, direction = b.copy(), b.copy()
    zeta, zeta_before = np.ones((len(shifts), columns)), np.ones((len(shifts), columns))
    beta_before, alpha = np.ones(columns), np.zeros(columns)
    size = (r * r).sum(0)
    goal = tolerance**2 * size
    for _ in range(PATIENCE * n):
        open_ = size > goal
        if not open_.any():
            break
        through = product(direction) + base * direction
        steep = (direction * through).sum(0)
        beta = np.where(open_, -size / np.where(open_, steep, 1.0), 0.0)
        s = shifts[:, None]
        below = beta * alpha * (zeta_before - zeta) + zeta_before * beta_before * (1 - s * beta)
        new = np.where(open_ & (below != 0), zeta * zeta_before * beta_before / np.where(below != 0, below, 1.0), 0.0)
        step = beta * new / np.where(zeta != 0, zeta, 1.0)
        x -= step[:, None] * p
        r = r + beta * through
        grown = (r * r).sum(0)
        alpha = np.where(open_, grown / np.where(size > 0, size, 1.0), 0.0)
        direction = np.where(open_, r + alpha * direction, 0.0)
        turn = alpha * new * step / np.where((zeta != 0) & (beta != 0), zeta * beta, 1.0)
        p = new[:, None] * r + turn[:, None] * p
        zeta_before, zeta, beta_before, size = np.where(open_, zeta, zeta_before), np.where(open_, new, zeta), np.where(open_, beta, beta_before), np.where(open_, grown, size)
    out = np.empty_like(x)
    out[order] = x
    return out
