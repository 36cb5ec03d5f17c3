"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) over every labelled text; the log-probability matrix of
languages x buckets has a fixed number of buckets and a checked number of languages, so it is
broadcast. Scoring turns a batch of texts into sparse rows of bucket counts and multiplies them.
Characters are code points, with A-Z in lower case. Long texts are counted in pieces, so that memory
stays bounded; they are cut at blanks, across which no n-gram is counted then.

Null and empty texts, and texts without a letter, get `und` and score 0. Rows whose label is
null don't train. With no training row at all, every text is `und`. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import buffers, code_points, pieces, utf8

UNKNOWN = "und"
#: n-gram lengths in characters; buckets; additive smoothing; languages that a model may hold (their matrix of doubles is 128 MB at most).
ORDERS, BUCKETS, ALPHA, MOST_LANGUAGES = (1, 2, 3), 1 << 14, 0.5, 1024
_CHUNK, _SLAB = 256 << 10, 1 << 22
_MULTIPLIERS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def grams(data: np.ndarray, offsets: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the row and the bucket of every n-gram of characters that lies within one text."""
    raw, at = code_points(data, offsets)
    raw = np.where((raw >= 65) & (raw < 91), raw + np.uint32(32), raw)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    shift = np.uint32(32 - (buckets - 1).bit_length())
    mixed = np.zeros(len(raw), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(raw) < n:
            return
        mixed = mixed[: len(raw) - n + 1] + (raw[n - 1 :] + np.uint32(1)) * _MULTIPLIERS[n - 1]
        if n in orders:
            h = mixed ^ (mixed >> np.uint32(15))
            h = (h * np.uint32(0x2C1B3C6D + 2 * n)) >> shift
            inside = rows[: len(h)] == rows[n - 1 :]
            yield (rows[: len(h)], h) if inside.all() else (rows[: len(h)][inside], h[inside])


def row_counts(data: np.ndarray, offsets: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a batch as sparse rows: row, bucket and count, in order."""
    keys = [row.astype(np.int64) * buckets + h for row, h in grams(data, offsets, orders, buckets)]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    key = np.sort(key.astype(np.int32) if (len(offsets) - 1) * buckets < 1 << 31 else key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first] // buckets, key[first] % buckets, np.diff(np.r_[first, len(key)])


def _counted(orders, buckets):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            langs, codes = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for first, some, at in pieces(data, offsets, _CHUNK):
                for row, h in grams(some, at, orders, buckets):
                    own = np.bincount(codes[first + row] * buckets + h, minlength=len(langs) * buckets).reshape(-1, buckets)
                    for k in np.flatnonzero(own.any(1)):
                        lang = str(langs[k])
                        sums[lang] = sums[lang] + own[k] if lang in sums else own[k]
        for lang, line in sums.items():
            at = np.flatnonzero(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(line[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    return count


@dataclass(frozen=True)
class LanguageModel:
    """languages, and the log-probability of each bucket for each of them (buckets x languages)."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def odds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-probability of each text under each language, without the prior."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        slab = max(1, _SLAB // max(1, len(self.languages)))
        for first, some, at in pieces(data, offsets, _CHUNK):
            row, bucket, n = row_counts(some, at, self.orders, len(self.weights))
            for low in range(0, len(row), slab):
                rows, worth = row[low : low + slab], self.weights[bucket[low : low + slab]] * n[low : low + slab, None]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                total[first + rows[starts]] += np.add.reduceat(worth, starts, axis=0)
        return total

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and its posterior probability, for each text."""
        total = self.odds(data, offsets) + self.prior
        best = total.argmax(1)
        top = total[np.arange(len(best)), best]
        return best, 1.0 / np.exp(total - top[:, None]).sum(1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", orders=ORDERS, buckets: int = BUCKETS, alpha: float = ALPHA) -> LanguageModel:
    """Learns from all rows whose language isn't null; the driver gets one number for each language and bucket."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), utf8(text).alias("text"))
    docs = rows.groupBy("lang").agg(F.count("*").alias("docs")).limit(MOST_LANGUAGES + 1).toPandas()
    if len(docs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the matrix would be too large to broadcast")
    counts = (
        rows.mapInArrow(_counted(orders, buckets), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(docs["lang"])
    table = np.zeros((buckets, len(languages)))
    at = {x: k for k, x in enumerate(languages)}
    table[counts["bucket"].to_numpy(int), counts["lang"].map(at).to_numpy(int)] = counts["n"]
    smooth = table + alpha
    prior = docs.set_index("lang")["docs"].reindex(languages).to_numpy(float)
    return LanguageModel(languages, np.log(prior / max(prior.sum(), 1)), np.log(smooth / smooth.sum(0)), tuple(orders))


def predict(model: LanguageModel, df: DataFrame, text: str = "text") -> Column:
    """A struct column (lang_pred, score) for the texts of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def identify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for texts, letters in batches:
            data, offsets = buffers(texts)
            best = np.full(len(texts), len(known.languages))
            score = np.zeros(len(texts))
            usable = letters.to_numpy(zero_copy_only=False).astype(bool)
            if known.languages and len(texts):
                got, p = known.score(data, offsets)
                best, score = np.where(usable, got, len(known.languages)), np.where(usable, p, 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return identify(utf8(text), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", into: str = "language", **options) -> DataFrame:
    """docs with a struct column (lang_pred, score), by a model learnt from `labelled`."""
    return docs.withColumn(into, predict(fit(labelled, text, lang, **options), docs, text))


def accuracy(scored: pd.DataFrame) -> float:
    """Share of held-out rows with the right language."""
    held = scored[scored["held_out"] & scored["lang"].notna()]
    return float((held["lang"] == held["lang_pred"]).mean()) if len(held) else float("nan")
