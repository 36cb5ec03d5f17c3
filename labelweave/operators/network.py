"""Operators on weighted networks held as edge rows (src, dst, w)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.operators.ranking import numbered
from labelweave.operators.windows import value_at_rank, with_totals


def symmetric(edges: DataFrame, order: str) -> DataFrame:
    """Both directions of each edge; of edges given twice, in either direction, the last by `order` counts, then the heaviest."""
    two = edges.select("src", "dst", "w", order).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", order))
    return two.groupBy("src", "dst").agg(F.max(F.struct(order, "w")).alias("last")).select("src", "dst", "last.w")


def degrees(edges: DataFrame) -> DataFrame:
    """Weighted degree of each node that starts an edge."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))


def degree_normalise(edges: DataFrame) -> DataFrame:
    """Each weight divided by the square roots of both ends' degrees; nodes of degree zero drop out."""
    deg = degrees(edges).where("degree > 0")
    left = deg.select(F.col("node").alias("src"), F.col("degree").alias("d_src"))
    right = deg.select(F.col("node").alias("dst"), F.col("degree").alias("d_dst"))
    return edges.join(left, "src").join(right, "dst").select("src", "dst", (F.col("w") / (F.sqrt("d_src") * F.sqrt("d_dst"))).alias("w"))


def column_normalise(edges: DataFrame) -> DataFrame:
    """Weights as shares of the sum over the edges into the same node."""
    total = edges.groupBy("dst").agg(F.sum("w").alias("total")).where("total > 0")
    return edges.join(total, "dst").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


def _threshold(edges: DataFrame, k: int, weight=None) -> DataFrame:
    """Beside each edge, the weight at rank k (from 0) of its row; rows with fewer edges have zeros there."""
    valued = edges.withColumn("_v", F.col("w") if weight is None else weight)
    return valued.join(value_at_rank(valued, "src", "_v", "dst", k), "src", "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)))


def transition_topk(edges: DataFrame, k: int) -> DataFrame:
    """Per row the weights above that of rank k, as shares of all weights from that of rank k on."""
    cut = with_totals(_threshold(edges, k), ("src",), _total=F.sum(F.when(F.col("_v") >= F.col("_least"), F.col("w"))))
    return cut.where(F.col("_v") > F.col("_least")).select("src", "dst", (F.col("w") / F.col("_total")).alias("w"))


def mean_with_transpose(edges: DataFrame) -> DataFrame:
    """(W + W') / 2, where an edge that isn't there weighs nothing."""
    two = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return two.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def knn_prune(edges: DataFrame, k: int) -> DataFrame:
    """Per row the weights whose size is above that of rank k, then the mean with the transpose."""
    cut = _threshold(edges, k, F.abs("w"))
    return mean_with_transpose(cut.where(F.col("_v") > F.col("_least")))


def row_scale(edges: DataFrame, nodes: int, eps: float = 0.0) -> DataFrame:
    """nodes * W, each row divided by the sum of the column of the same node."""
    total = edges.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * nodes).alias("total"))
    return edges.join(total, F.col("src") == F.col("node")).select("src", "dst", (F.col("w") * nodes / (F.col("total") + eps)).alias("w"))


def mean_network(networks: list[DataFrame]) -> DataFrame:
    """Mean weight of each edge over the networks that have it."""
    union = networks[0]
    for other in networks[1:]:
        union = union.unionByName(other)
    return union.groupBy("src", "dst").agg(F.avg("w").alias("w"))


def overlay(own: DataFrame, mean: DataFrame) -> DataFrame:
    """A network's own weights, and the mean network's where it has none."""
    other = mean.select("src", "dst", F.col("w").alias("m"))
    return own.join(other, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("w", "m").alias("w"))


def enhance(edges: DataFrame, alpha: float = 0.9, neighbours: int = 20) -> DataFrame:
    """A denoised network: neighbours pruned, diffused over its transition fields through a filtered spectrum.

    Scaling and pruning are relational. The filtered spectrum is a function of the transition fields' matrix T T', whose eigenvalues are
    between 0 and 1, so its columns are sums of Chebyshev polynomials, made by sparse products and some columns at a time;
    first the diagonal, then the cells. Driver and tasks hold the pruned edges (24 bytes each), tasks so many columns besides;
    cells are as many as pairs of nodes that a path joins. Networks of under ten nodes prune to nothing, as k is a tenth of their nodes.
    """
    spark = edges.sparkSession
    plain = edges.where("src <> dst")
    n = plain.select("src").union(plain.select("dst")).distinct().count()
    k = min(neighbours, n // 10)
    pruned = checkpoint(knn_prune(mean_with_transpose(row_scale(plain, n, float(np.finfo(float).eps))), k))
    names = numbered(pruned.select(F.col("src").alias("node")).union(pruned.select("dst")).distinct(), "node", into="id")
    left, right = (names.select(F.col("node").alias(c), F.col("id").alias(x)) for c, x in (("src", "i"), ("dst", "j")))
    links = pruned.where("src <> dst").join(F.broadcast(left), "src").join(F.broadcast(right), "dst").select("i", "j", "w").toArrow()
    sums = plain.groupBy(F.col("dst").alias("node")).agg(F.sum(F.abs("w")).alias("total"))
    totals = names.join(sums, "node", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total")).toArrow()
    size = totals.num_rows
    weight = np.zeros(size)
    weight[totals["id"].to_numpy()] = totals["total"].to_numpy()
    fields = transition_fields(size, n, links["i"].to_numpy(), links["j"].to_numpy(), links["w"].to_numpy())
    terms = chebyshev(lambda v: (1 - alpha) * v / (1 - alpha * v**2))
    step = int(np.clip((1 << 22) // max(1, size), 1, 64))
    blocks = -(-size // step)
    starts = spark.range(0, blocks, 1, max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism)))
    held = spark.sparkContext.broadcast(fields)

    def columns(parts: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in parts:
            for block in part.column(0).to_pylist():
                yield np.arange(block * step, min(size, (block + 1) * step))

    def diagonal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """T_2k = 2 T_k T_k - 1 and T_2k+1 = 2 T_k T_k+1 - T_1, so that half of the products do."""
        for own in columns(parts):
            at, total = (own, np.arange(len(own))), np.zeros(len(own))
            polynomials = held.value.polynomials(own, -(-len(terms) // 2) + 1)
            last, first = next(polynomials), None
            for d in range(0, len(terms), 2):
                if d:
                    last, now = now, next(polynomials)  # noqa: F821
                else:
                    now = next(polynomials)
                    first = now[at].copy()
                total += terms[d] * (2 * np.einsum("ij,ij->j", last, last) - 1)
                if d + 1 < len(terms):
                    total += terms[d + 1] * (2 * np.einsum("ij,ij->j", last, now) - first)
            yield pa.RecordBatch.from_pydict({"id": own, "own": total})

    found = starts.mapInArrow(diagonal, "id long, own double").toArrow()
    share = np.zeros(size)
    share[found["id"].to_numpy()] = weight[found["id"].to_numpy()] / (1 - found["own"].to_numpy())
    shares = spark.sparkContext.broadcast(share)

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = shares.value
        for own in columns(parts):
            total = np.zeros((size, len(own)))
            for term, polynomial in zip(terms, held.value.polynomials(own, len(terms)), strict=True):
                total += term * polynomial
            for c, j in enumerate(own):
                w = total[:j, c] * (share[:j] + share[j]) / 2
                i = np.flatnonzero(w > 0)
                yield pa.RecordBatch.from_pydict({"i": i, "j": np.full(len(i), j), "w": w[i]})

    src, dst = (F.broadcast(names.select(F.col("id").alias(x), F.col("node").alias(c))) for c, x in (("src", "i"), ("dst", "j")))
    return starts.mapInArrow(cells, "i long, j long, w double").join(src, "i").join(dst, "j").select("src", "dst", "w")


def chebyshev(f: Callable[[np.ndarray], np.ndarray], most: int = 2048) -> np.ndarray:
    """The coefficients of f on [0, 1] in Chebyshev polynomials of 2 v - 1, as far as doubles tell them."""
    angle = np.pi * (np.arange(most) + 0.5) / most
    at = (np.cos(angle) + 1) / 2
    values, eps = f(at - np.finfo(float).eps), np.finfo(float).eps
    found = 2 / most * np.cos(np.outer(np.arange(most // 2), angle)) @ values
    found[0] /= 2
    small = np.abs(found) <= 4 * eps * np.abs(values).max()  # the first two such in a row end the sum: later ones are rounding
    ends = np.flatnonzero(small[:-1] & small[1:])
    return found[: max(1, int(ends[0]))] if len(ends) else found


#: Cells of the dense columns of nodes with most edges; edges that a product takes at once.
HUBS, EDGES = 1 << 22, 1 << 16


class Fields:
    """A matrix T of a diagonal, edges as sorted triples, and the columns and rows of nodes with most edges, which are dense."""

    def __init__(self, own: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        self.own, size = own, len(own)
        degree = np.bincount(i, minlength=size) + np.bincount(j, minlength=size)
        self.hubs = np.sort(np.argsort(-degree, kind="stable")[: min(256, HUBS // max(1, size))])
        self.hubs = self.hubs[degree[self.hubs] > 64]
        place = np.full(size, -1)
        place[self.hubs] = np.arange(len(self.hubs))
        self.into, self.out = np.zeros((size, len(self.hubs))), np.zeros((len(self.hubs), size))
        to = place[j] >= 0
        self.into[i[to], place[j[to]]] = w[to]
        of = ~to & (place[i] >= 0)
        self.out[place[i[of]], j[of]] = w[of]
        rest = ~to & ~of
        self.sparse = [self._sorted(i[rest], j[rest], w[rest]), self._sorted(j[rest], i[rest], w[rest])]

    @staticmethod
    def _sorted(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        return i[first], first, j, w

    def _edges(self, out: np.ndarray, x: np.ndarray, way: int) -> np.ndarray:
        rows, first, j, w = self.sparse[way]
        ends = np.r_[first[1:], len(j)]
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(ends, first[low] + EDGES, side="right")))
            a, b = first[low], ends[high - 1]
            out[rows[low:high]] += np.add.reduceat(x[j[a:b]] * w[a:b, None], first[low:high] - a)
            low = high
        return out

    def product(self, x: np.ndarray) -> np.ndarray:
        """T T' x."""
        y = self._edges(self.own[:, None] * x, x, 1) + self.out.T @ x[self.hubs]
        y[self.hubs] += self.into.T @ x
        z = self._edges(self.own[:, None] * y, y, 0) + self.into @ y[self.hubs]
        z[self.hubs] += self.out @ y
        return z

    def polynomials(self, own: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The columns `own` of the first n Chebyshev polynomials of 2 T T' - 1."""
        last = np.zeros((len(self.own), len(own)))
        last[own, np.arange(len(own))] = 1.0
        now = 2 * self.product(last) - last
        for _ in range(n):
            yield last
            last, now = now, 4 * self.product(now) - 2 * now - last


def transition_fields(size: int, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> Fields:
    """Edges and, as each node's own weight, one more than their sum; rows over the same node's column sums, columns over the roots of theirs."""
    eps = np.finfo(float).eps
    own = 1 + np.bincount(i, np.abs(w), minlength=size)
    total = np.bincount(j, n * w, minlength=size) + n * own + eps
    own, w = n * own / total, n * w / total[i]
    root = np.sqrt(np.bincount(j, np.abs(w), minlength=size) + np.abs(own) + eps)
    return Fields(own / root, i, j, w / root[j])
