"""Hard negatives by slot-decomposed selection.

An anchor's positives are the first rows of its label by score. Each positive allows negatives
between two shares of its own score, so the windows of an anchor overlap. Their different upper
limits, sorted, cut the scores below the highest one into disjoint slots. Every task keeps the first
k rows of each slot (its combiner), a window over anchor and slot keeps the first k of what tasks
kept, and the slots of an anchor together are one array in rank order: the suffix that begins with
the slot below a positive's upper limit is merged down to its first k, and its lower limit cuts
what is left. One pass over all rows so answers all windows of an anchor.

Anchors are taken in blocks of bounded bytes. A block is broadcast, all rows are scanned for its
positives and once more for its negatives, its rows are written to the shared folder and its
broadcast is destroyed before the next block begins. Rows are never shuffled, only what combiners
keep is.

Scores are exact: components become floor(scale * x), products are summed as doubles where they stay
below 2^53 and as Python's integers elsewhere, limited to the range of long. Of vectors of different
lengths the longer one's surplus counts as nothing; an empty vector scores 0. Rows with a null label,
a null vector or a component that is null or no finite number (scaled, too) take no part. A null id is no anchor
and comes last among equal scores. Every row stands for itself: repeated rows are several positives or
negatives, and a repeated anchor gives its rows once each time. A positive without negatives
gives no row, so a table without anchors or of one label gives none. Columns besides id, label and
vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import checkpoint, shared_folder

#: Positives of an anchor and negatives of a positive; shares of a positive's score, in hundredths, between which a negative lies.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Bytes of vectors, and anchors, of one block on average at most: anchors are dealt to blocks by hash (a longer vector is a block of its own).
BLOCK_BYTES, BLOCK_ANCHORS = 8 << 20, 4096
#: Scores that a task holds at once.
_CELLS = 1 << 21
_NONE = np.iinfo(np.int64).min
_KEPT = "anchor int, slot int, score long, id long"


class Scorer:
    """The vectors of a block of anchors, and their exact scores against rows."""

    def __init__(self, vectors: list[np.ndarray]):
        self.width = max((len(v) for v in vectors), default=0)
        self.matrix = np.zeros((len(vectors), self.width))
        for k, v in enumerate(vectors):
            self.matrix[k, : len(v)] = v
        self.most = float(np.abs(self.matrix).sum(1).max(initial=0.0))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """anchors x rows, as int64."""
        width = min(self.width, rows.shape[1])
        a, b = self.matrix[:, :width], rows[:, :width]
        if self.most * float(np.abs(b).max(initial=0.0)) < 2.0**53:
            return (a @ b.T).astype(np.int64)
        whole = lambda m: np.array([[int(x) for x in line] for line in m], object).reshape(m.shape)
        exact = whole(a) @ whole(b).T if width else np.zeros((len(a), len(b)), object)
        return np.array([[max(-(2**63) + 1, min(2**63 - 1, int(x))) for x in line] for line in exact], np.int64).reshape(exact.shape)


def vectors_of(column: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """The first row and a matrix of floor(scale * x) for runs of rows with equally long vectors."""
    at = np.asarray(column.offsets, np.int64)
    values = np.floor(scale * np.asarray(column.values, np.float64)[at[0] : at[-1]])
    at, lengths = at - at[0], np.diff(at)
    edges = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1], True]) if len(lengths) else np.zeros(0, int)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(low), values[at[low] : at[high]].reshape(high - low, int(lengths[low]))


class TopSlots:
    """The first k rows by score (high first) and id (low first) of each anchor and slot, whatever the order they come in."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.score = np.full((anchors * slots, k), _NONE)
        self.id = np.full((anchors * slots, k), np.iinfo(np.int64).max)
        self.floor = self.score[:, -1].copy()

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        place = anchor * self.slots + slot
        useful = score >= self.floor[place]  # an equal score may have a smaller id
        place, score, id_ = place[useful], score[useful], id_[useful]
        if not len(place):
            return
        touched, place = np.unique(place, return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.k)
        place, score, id_ = np.r_[held, place], np.r_[self.score[touched].ravel(), score], np.r_[self.id[touched].ravel(), id_]
        order = np.lexsort((id_, ~score, place))  # ~ turns the order round without overflow
        place, score, id_ = place[order], score[order], id_[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        first = rank < self.k
        self.score[touched], self.id[touched] = score[first].reshape(-1, self.k), id_[first].reshape(-1, self.k)
        self.floor[touched] = self.score[touched, -1]

    def batch(self) -> pa.RecordBatch:
        place, k = np.nonzero(self.score != _NONE)
        arrays = [(place // self.slots).astype(np.int32), (place % self.slots).astype(np.int32), self.score[place, k], self.id[place, k]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["anchor", "slot", "score", "id"])


def _combine(shared, k: int, slots: int, scale: float, candidates):
    """A task: keeps the first k of each anchor and slot among the rows that candidates(block, scores, labels) points out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        scorer = Scorer(block["vectors"])
        top = TopSlots(len(block["vectors"]), slots, k)
        step = max(1, _CELLS // max(1, len(block["vectors"])))
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, matrix in vectors_of(batch.column(2), scale):
                low, size = 0, 64
                while low < len(matrix):  # short steps first: the floors they set spare most of the work on later ones
                    rows = slice(first + low, first + min(low + size, len(matrix)))
                    scores = scorer.scores(matrix[low : low + size])
                    for anchor, slot, row in candidates(block, scores, labels[rows]):
                        hopeful = scores[anchor, row] >= top.floor[anchor * slots + slot]
                        anchor, slot, row = anchor[hopeful], slot[hopeful], row[hopeful]
                        top.add(anchor, slot, scores[anchor, row], ids[rows][row])
                    low, size = low + size, min(step, size * 4)
        yield top.batch()

    return run


def _same_label(block: dict, scores: np.ndarray, labels: np.ndarray):
    anchor, row = np.nonzero(block["labels"][:, None] == labels[None, :])
    yield anchor, np.zeros(len(anchor), np.int64), row


def _in_slots(block: dict, scores: np.ndarray, labels: np.ndarray):
    """Rows of other labels between an anchor's lowest lower limit and its highest upper one, with the slot that each lies in."""
    limits = block["limits"]
    anchor, row = np.nonzero((scores <= limits[:, :1]) & (scores >= block["least"][:, None]) & (block["labels"][:, None] != labels[None, :]))
    value = scores[anchor, row]
    slot = np.zeros(len(anchor), np.int64)
    for j in range(1, limits.shape[1]):
        slot += value <= limits[anchor, j]
    yield anchor, slot, row


def _first(kept: DataFrame, k: int) -> DataFrame:
    """What tasks kept, down to the first k of each anchor and slot; at most k rows of each task meet."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _limits(positives: list[list[tuple[int, int]]], low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """For each anchor its upper limits from high to low (padded) and its least lower limit; a row (anchor, positive, score, slot, lower limit) for each positive."""
    wide = max(1, max((len(p) for p in positives), default=1))
    limits, least, rows = np.full((len(positives), wide), _NONE), np.full(len(positives), np.iinfo(np.int64).max), []
    for a, own in enumerate(positives):
        windows = [(p, s, high * s // 100, -(-low * s // 100)) for p, s in own]
        windows = [w for w in windows if w[3] <= w[2]]  # no score lies between the shares of a negative one
        uppers = sorted({w[2] for w in windows}, reverse=True)
        limits[a, : len(uppers)] = uppers
        if windows:
            least[a] = min(w[3] for w in windows)
        rows += [(a, p, s, uppers.index(u), lower) for p, s, u, lower in windows]
    return limits, least, rows


def _without_self(found: list[tuple[int, int]], own: tuple[int, int], k: int) -> list[tuple[int, int]]:
    """The first k without the anchor itself: one entry of its id and its score with itself, if that is among them."""
    if own in found:
        found.remove(own)
    return found[:k]


def _block(rows: DataFrame, ids: np.ndarray, block: dict, scale: float, positives: int, negatives: int, low: int, high: int, path: str) -> None:
    """Writes (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of one block of anchors."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    kept = rows.mapInArrow(_combine(shared, positives + 1, 1, scale, _same_label), _KEPT)
    best = _first(kept, positives + 1).toPandas().sort_values(["anchor", "score", "id"], ascending=[True, False, True])
    shared.destroy()
    own = [int(min(max(sum(int(x) * int(x) for x in v), -(2**63) + 1), 2**63 - 1)) for v in block["vectors"]]
    listed = [[] for _ in ids]
    for a, s, i in zip(best["anchor"], best["score"], best["id"], strict=True):
        listed[a].append((int(i), int(s)))
    near = [_without_self(listed[a], (int(ids[a]), own[a]), positives) for a in range(len(ids))]
    limits, least, asked = _limits(near, low, high)
    shared = spark.sparkContext.broadcast(block | {"limits": limits, "least": least})
    kept = _first(rows.mapInArrow(_combine(shared, negatives, limits.shape[1], scale, _in_slots), _KEPT), negatives)
    slots = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id"))).alias("kept"))
    windows = spark.createDataFrame([(a, int(ids[a]), p, s, k, x) for a, p, s, k, x in asked], "anchor int, anchor_id long, positive_id long, positive_score long, first long, least long")
    suffix = F.slice(F.filter("kept", lambda x: x["slot"] >= F.col("first")), 1, negatives)
    merged = windows.join(slots, "anchor").select("anchor_id", "positive_id", "positive_score", F.filter(suffix, lambda x: -x["minus"] >= F.col("least")).alias("kept"))
    shown = merged.select("anchor_id", "positive_id", "positive_score", F.posexplode("kept").alias("rank", "kept"))
    null = lambda c: F.when(F.col(c) != np.iinfo(np.int64).max, F.col(c))
    shown.select("anchor_id", null("positive_id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("kept.id").alias("negative_id"), "positive_score", (-F.col("kept.minus")).alias("negative_score")).withColumn(
        "negative_id", null("negative_id")
    ).write.mode("append").parquet(path)
    shared.destroy()


def usable(rows: DataFrame, id_: str, label: Column, vector: str, scale: float) -> DataFrame:
    """(id, label, vector) of the rows that take part; a null id is the largest long."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    part = rows.where(label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    return part.select(F.coalesce(F.col(id_).cast("long"), F.lit(np.iinfo(np.int64).max)).alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def mine(rows: DataFrame, anchors: Column, id_: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor that `anchors` is true of."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    part = usable(rows, id_, label, vector, scale)
    asked = checkpoint(usable(rows.where(anchors & F.col(id_).isNotNull()), id_, label, vector, scale).withColumn("n", F.monotonically_increasing_id()))
    count, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * max(1, width or 1))))
    blocks = -(-count // size)
    path = shared_folder(spark)
    spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").write.parquet(path)
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            vectors = [line for column in own.column("vector").chunks for _, m in vectors_of(column, scale) for line in m]
            block = {"vectors": vectors, "labels": own.column("label").to_numpy()}
            _block(part, own.column("id").to_numpy(), block, scale, positives, negatives, low, high, path)
    return spark.read.parquet(path)
