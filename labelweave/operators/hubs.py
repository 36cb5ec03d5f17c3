"""The walk with restart on networks whose edges all touch a hub, without moving an edge.

Hubs' scores, a small part of all, go to the tasks as a broadcast; a node that isn't a hub (a leaf) has its scores from its hubs'
scores of the step before, wherever its edges are kept, and only sums for hubs come back. So a step's exchange grows with hubs x labels, not
with edges. What a task needs of a leaf is one list of numbered entries: hubs it hears from, hubs that hear from it, its seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.lineage import checkpoint
from labelweave.operators.ranking import numbered

#: Networks of so many nodes have hubs only; hubs at most; bytes of their scores at once; labels at once.
SMALL, MOST, HELD, LABELS = 1 << 14, 1 << 22, 48 << 20, 32
#: Keys of seeds' labels begin here.
_SEED = 1 << 30


class Hubs:
    """A network and seeds as lists of entries, ready to step; `of` gives None for networks with edges that touch no hub."""

    @classmethod
    def of(cls, normal: DataFrame, r: DataFrame, labels: list[str], small: int | None = None) -> Hubs | None:
        degree = normal.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
        size, ends = degree.agg(F.count("*"), F.sum("n")).first()
        kept = degree if size <= (SMALL if small is None else small) else degree.where(F.col("n") > 2 * ends / size)
        names = checkpoint(numbered(kept.select("node"), "node", into="id").select("node", F.col("id").cast("int").alias("id")))
        count = names.count()
        if not 0 < count <= MOST:
            return None
        src, dst = (F.broadcast(names.select(F.col("node").alias(c), F.col("id").alias(x))) for c, x in (("src", "i"), ("dst", "j")))
        ends = normal.join(src, "src", "left").join(dst, "dst", "left")
        places = F.create_map(*[F.lit(y) for k, x in enumerate(labels) for y in (x, k)])
        sown = r.select("node", F.element_at(places, F.col("label")).alias("label"), "r").join(F.broadcast(names), "node", "left")
        heard = ends.where("i IS NULL").select(F.col("src").alias("node"), F.col("j").alias("key"), "w")  # null: two leaves
        told = ends.where("j IS NULL AND i IS NOT NULL").select(F.col("dst").alias("node"), (-F.col("i") - 1).alias("key"), "w")
        seeds = sown.where("id IS NULL").select("node", (F.col("label") + _SEED).alias("key"), F.col("r").alias("w"))
        lists = [F.collect_list(F.coalesce("key", F.lit(-(1 << 31)))).alias("keys"), F.collect_list("w").alias("ws")]
        leaves = checkpoint(heard.unionByName(told).unionByName(seeds).groupBy("node").agg(*lists))
        if not leaves.where(F.array_contains("keys", -(1 << 31))).isEmpty():
            return None
        inner = ends.where("i IS NOT NULL AND j IS NOT NULL").groupBy("i").agg(F.collect_list("j").alias("keys"), F.collect_list("w").alias("ws"))
        return cls(names, count, leaves, checkpoint(inner), sown.where("id IS NOT NULL").select("id", "label", "r").toArrow(), labels)

    def __init__(self, names: DataFrame, count: int, leaves: DataFrame, inner: DataFrame, sown: pa.Table, labels: list[str]) -> None:
        self.names, self.count, self.leaves, self.inner, self.sown, self.labels = names, count, leaves, inner, sown, labels
        self.side_by_side = int(np.clip(HELD // (8 * count), 1, LABELS))

    def blocks(self) -> Iterator[range]:
        for low in range(0, len(self.labels), self.side_by_side):
            yield range(low, min(len(self.labels), low + self.side_by_side))

    def start(self, block: range) -> np.ndarray:
        """The hubs' seeds, a row a label."""
        out = np.zeros((len(block), self.count))
        label, at, r = (self.sown[c].to_numpy() for c in ("label", "id", "r"))
        own = (label >= block.start) & (label < block.stop)
        np.add.at(out, (label[own] - block.start, at[own]), r[own])
        return out

    def step(self, block: range, seeds: np.ndarray, before: np.ndarray | None, now: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """The hubs' scores after those `now` (`before` is one step earlier, None at the start), and how much each label's scores change by the step."""
        sc, count, n = self.names.sparkSession.sparkContext, self.count, len(block)
        held = sc.broadcast((before, now))

        def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (old, new), total, change, seen = held.value, np.zeros((n, count)), np.zeros(n), False
            for part in parts:
                seen = True
                size, rows, keys, ws = _entries(part)
                out = keys < 0
                to, of, w = -keys[out] - 1, rows[out], alpha * ws[out]
                was, became = (_heard(size, rows, keys, ws, block, h, alpha) for h in (old, new))
                for c in range(n):
                    total[c] += np.bincount(to, w * was[c][of], minlength=count)
                    change[c] += np.abs(became[c] - was[c]).sum()
            if seen:
                yield from _sums(total, change)

        def inner(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            new, total, seen = held.value[1], np.zeros((n, count)), False
            for part in parts:
                seen = True
                _, rows, keys, ws = _entries(part)
                to, w = part.column(0).to_numpy()[rows], alpha * ws
                for c in range(n):
                    total[c] += np.bincount(to, w * new[c][keys], minlength=count)
            if seen:
                yield from _sums(total, np.zeros(n))

        schema = ", ".join(["at int", *[f"v{c} double" for c in range(n)]])
        parts = self.leaves.mapInArrow(told, schema).unionByName(self.inner.mapInArrow(inner, schema))
        found = parts.groupBy("at").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(n)]).toArrow()
        held.destroy()
        at, after, change = found["at"].to_numpy(), (1 - alpha) * seeds, np.zeros(n)
        for c in range(n):
            values = found[f"v{c}"].to_numpy()
            change[c] = values[at < 0].sum()
            after[c][at[at >= 0]] += values[at >= 0]
        return after, change + np.abs(after - now).sum(1)

    def scores(self, block: range, before: np.ndarray | None, now: np.ndarray, alpha: float) -> DataFrame:
        """(node, label, p) of all nodes with a score, for the hubs' scores `now` and those one step earlier."""
        names = pa.array([self.labels[k] for k in block])
        held = self.names.sparkSession.sparkContext.broadcast((before, now))

        def rows(nodes: pa.Array, values: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for c, p in enumerate(values):
                at = np.flatnonzero(p > 0)
                yield pa.RecordBatch.from_pydict({"node": nodes.take(pa.array(at)), "label": names.take(pa.array(np.full(len(at), c))), "p": p[at]})

        def of_leaves(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                size, at, keys, ws = _entries(part)
                yield from rows(part.column(0), _heard(size, at, keys, ws, block, held.value[0], alpha))

        def of_hubs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield from rows(part.column(0), (p[part.column(1).to_numpy()] for p in held.value[1]))

        schema = "node string, label string, p double"
        return self.leaves.mapInArrow(of_leaves, schema).unionByName(self.names.mapInArrow(of_hubs, schema))


def _entries(part: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and each entry's row, key and weight."""
    keys, ws = part.column("keys"), part.column("ws")
    return part.num_rows, np.repeat(np.arange(part.num_rows), np.diff(keys.offsets.to_numpy())), keys.flatten().to_numpy().astype(np.int64), ws.flatten().to_numpy()


def _heard(size: int, rows: np.ndarray, keys: np.ndarray, ws: np.ndarray, block: range, hubs: np.ndarray | None, alpha: float) -> list[np.ndarray]:
    """Each label's scores of the leaves from the hubs' scores one step before; None: their seeds."""
    seed = (keys >= _SEED + block.start) & (keys < _SEED + block.stop)
    out = np.zeros((len(block), size))
    np.add.at(out, (keys[seed] - _SEED - block.start, rows[seed]), ws[seed] * (1.0 if hubs is None else 1 - alpha))
    if hubs is not None:
        heard = (keys >= 0) & (keys < _SEED)
        of, to, w = keys[heard], rows[heard], alpha * ws[heard]
        for c in range(len(block)):
            out[c] += np.bincount(to, w * hubs[c][of], minlength=size)
    return list(out)


def _sums(total: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The hubs' sums that aren't all 0, and as hub -1 the change."""
    at = np.flatnonzero(total.any(0)).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"at": np.r_[np.int32(-1), at].astype(np.int32), **{f"v{c}": np.r_[change[c], total[c][at]] for c in range(len(total))}})
