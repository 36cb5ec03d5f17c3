"""Language-model scores from a log-frequency Bloom filter.

Tokens are lower-cased words and one end for each text; a start stands before them. Training counts
all words and all word pairs of all training texts: tasks count what they read, and send sorted
runs of hashes by shard (a range of the hash space); a shard's runs are merged in one task. The
number of shards follows the size of the texts, so a shard stays small at any size.

Counts are quantised to 1, 2, 3, 4, 6, 8, 12, 16, …, rounded down. Every pair is put into its shard's
filter once for each level up to that of its count, so that the quantised count comes back from
repeated membership probes. Word counts are kept exactly, by 64-bit hash. The probability of a word
is PAIR_WEIGHT times the quantised count of the pair over the count of the word before, and the rest
times the word's own; as counts are rounded down, the successors of a word sum to 1 at most, but for
the filter's false hits (under 2 in 1000 probed pairs).

A model of at most MOST_BYTES is broadcast whole. The pairs and words of a larger one are looked up
where their shard is: chunks of texts send their different hashes to the shards and get levels and
counts back. That is one shuffle each way, whatever the size of the model; the scores are the same.

Null and empty texts are one end token. Repeated rows count and score each time. Without training
texts every count is 0. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import buffers, checkpoint, fresh, mix64, spans, utf8

#: Filter bits for each entry, probes for each entry, weight of the pair's probability.
BITS, PROBES, PAIR_WEIGHT = 18, 4, 0.6
#: Words in a shard on average at most; bytes of a model that is broadcast.
SHARD_WORDS, MOST_BYTES = 2_000_000, 256 << 20
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_FLUSH, _CHUNK, _LEVELS = 4_000_000, 4 << 20, 90
_SCORES = "n_tokens long, n_known long, base_score double, score double"


class _Words(dict):
    """Numbers words in order of appearance; keeps their hashes. Number 0 is the start, 1 the end."""

    def __init__(self):
        self.hashes = [int(_START), int(_END)]

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh64_intdigest(word))
        number = self[word] = len(self.hashes) - 1
        return number


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens, a start before each text and an end behind it; the place of each start; hashes by number."""
    words = _Words()
    parts, at, starts = [], 0, []
    for text in texts:
        split = text.lower().split()
        numbers = np.empty(len(split) + 2, np.int64)
        numbers[0], numbers[-1] = 0, 1
        numbers[1:-1] = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
        parts.append(numbers)
        starts.append(at)
        at += len(numbers)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts, np.int64), np.array(words.hashes, np.uint64)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, with the sums of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order].astype(np.uint64)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _counter(bits: int):
    """Counts words (kind 1) and pairs (kind 2) of the texts of a task."""

    def flush(kind: int, held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        h, c = summed(*held)
        cuts = np.searchsorted(shard_of(h, bits), np.arange((1 << bits) + 1))
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        for part in range(0, len(rows), 64):
            some = rows[part : part + 64]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * len(some), pa.int32()),
                    pa.array([s for s, _, _ in some], pa.int32()),
                    pa.array([h[a:b].tobytes() for _, a, b in some], pa.binary()),
                    pa.array([c[a:b].tobytes() for _, a, b in some], pa.binary()),
                ],
                ["kind", "shard", "hashes", "counts"],
            )
        held[0].clear(), held[1].clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = ([], []), ([], [])
        for batch in batches:
            _, offsets = buffers(batch.column(0))
            for a, b in spans(offsets, _CHUNK):
                numbers, starts, hashes = tokens_of(batch.column(0)[a:b].to_pylist())
                n = np.bincount(numbers, minlength=len(hashes))
                words[0].append(hashes), words[1].append(n.astype(np.uint64))
                key = (numbers[:-1] << 32) | numbers[1:]
                key = np.sort(np.delete(key, starts[1:] - 1))
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                pairs[0].append(pair_hash(hashes[key[first] >> 32], hashes[key[first] & 0xFFFFFFFF]))
                pairs[1].append(np.diff(np.r_[first, len(key)]).astype(np.uint64))
                for kind, held in ((1, words), (2, pairs)):
                    if sum(map(len, held[0])) > _FLUSH:
                        yield from flush(kind, held)
        for kind, held in ((1, words), (2, pairs)):
            if held[0]:
                yield from flush(kind, held)

    return count


def level_of(counts: np.ndarray) -> np.ndarray:
    """The greatest level whose value is at most the count; counts are 1 or more."""
    octave = np.frexp(counts.astype(float))[1] - 1
    return np.where(octave == 0, 1, 2 * octave + (counts >= 1.5 * np.exp2(octave)))


#: The count that each level stands for; level 0 is no hit.
VALUES = np.array([0, 1, *(v for k in range(1, _LEVELS // 2) for v in (2.0**k, 1.5 * 2**k))])


def _places(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a level begin, and the step from one to the next."""
    mixed = mix64(hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
    return mixed >> np.uint64(32), mixed | np.uint64(1)


def _bit(begin: np.ndarray, step: np.ndarray, probe: int, sizes: np.ndarray) -> np.ndarray:
    """The bit of a probe, below the size of the shard's filter."""
    return (((begin + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * sizes) >> np.uint64(32)


def build_filter(hashes: np.ndarray, counts: np.ndarray, bits: int = BITS, probes: int = PROBES) -> np.ndarray:
    """Bytes of the filter that holds each hash at levels 1 to that of its count."""
    levels = level_of(counts)
    size = (int(levels.sum()) * bits // 64 + 1) * 64
    field = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        begin, step = _places(hashes[levels >= level], level)
        for probe in range(probes):
            field[_bit(begin, step, probe, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(field, bitorder="little")


def probed(hashes: np.ndarray, filters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, probes: int) -> np.ndarray:
    """Level of each hash, in the filter that starts at a byte and has so many bits: the last level at which all probes hit."""
    found = np.zeros(len(hashes), np.int8)
    at = np.flatnonzero(sizes)
    hashes, starts, sizes = hashes[at], starts[at], sizes[at]
    for level in range(1, len(VALUES)):
        begin, step = _places(hashes, level)
        for probe in range(probes):
            bit = _bit(begin, step, probe, sizes)
            hit = (filters[starts + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            if not hit.all():
                at, hashes, starts, sizes, begin, step = (x[hit] for x in (at, hashes, starts, sizes, begin, step))
        if not len(at):
            break
        found[at] = level
    return found


def counted(hashes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of hashes among words (in order), 0 for others."""
    if not len(words):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, counts[at], 0).astype(np.int64)


def _merge(bits: int, probes: int):
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        h, c = summed(
            [np.frombuffer(x.as_py(), np.uint64) for x in group["hashes"]], [np.frombuffer(x.as_py(), np.uint64) for x in group["counts"]]
        )
        total, different = int(c.sum()), len(h)
        if key[0].as_py() == 1:
            kept, body = h, (c.astype(np.uint32) if c.max() < 1 << 32 else c)
        else:
            kept, body = h[:0], build_filter(h, c, bits, probes)
        row = [[x] for x in (key[0].as_py(), key[1].as_py(), kept.tobytes(), body.tobytes(), body.dtype.itemsize, total, different)]
        return pa.table([pa.array(x, k) for x, k in zip(row, _MERGED_TYPES, strict=True)], names=_MERGED_NAMES)

    return merge


_MERGED = "kind int, shard int, hashes binary, body binary, width int, total long, different long"
_MERGED_NAMES = [x.split()[0] for x in _MERGED.split(", ")]
_MERGED_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]


@dataclass(frozen=True)
class Totals:
    """Tokens, different tokens and texts of the training texts."""

    tokens: int
    vocabulary: int
    texts: int

    def scores(self, counts: np.ndarray, levels: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text, from the count of each token (0 at starts) and the level of its pair."""
        base = (counts + 1) / (self.tokens + self.vocabulary + 1)
        context = np.r_[0, counts[:-1]].astype(float)
        context[np.minimum(starts + 1, len(context) - 1)] = self.texts
        seen = np.minimum(VALUES[levels], context)
        pair = np.divide(seen, context, out=np.zeros(len(seen)), where=context > 0)
        weight = np.where(context > 0, PAIR_WEIGHT, 0.0)
        score = np.log10(weight * pair + (1 - weight) * base)
        base = np.log10(base)
        base[starts] = score[starts] = 0
        known = counts > 0
        return [
            np.diff(np.r_[starts, len(counts)]) - 1,
            np.add.reduceat(known.astype(np.int64), starts),
            np.add.reduceat(base, starts),
            np.add.reduceat(score, starts),
        ]


@dataclass(frozen=True)
class Model:
    """All shards of word counts and filters of a model that is small enough."""

    bits: int
    probes: int
    totals: Totals
    words: np.ndarray
    counts: np.ndarray
    starts: np.ndarray  # for each shard: first byte of its filter
    sizes: np.ndarray  # for each shard: bits of its filter
    filters: np.ndarray

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, starts included: its word count (0 at starts) and the level of its pair; and the places of the starts."""
        numbers, starts, hashes = tokens_of(texts)
        known = counted(hashes, self.words, self.counts)
        known[0] = 0
        levels = np.zeros(len(numbers), np.int8)
        key = (numbers[:-1] << 32) | numbers[1:]
        different = np.sort(key)  # pairs that recur in these texts are probed once
        different = different[np.r_[True, different[1:] != different[:-1]]]
        pairs = pair_hash(hashes[different >> 32], hashes[different & 0xFFFFFFFF])
        shard = shard_of(pairs, self.bits)
        levels[1:] = probed(pairs, self.filters, self.starts[shard], self.sizes[shard], self.probes)[np.searchsorted(different, key)]
        levels[starts] = 0
        return known[numbers], levels, starts


def train(docs: DataFrame, text: str = "text", bits: int = BITS, probes: int = PROBES, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """Merged shards of docs' counts, as a checkpointed table, and the number of bits that choose a shard."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shard_bits = max(0, (int(size) // 6 // shard_words).bit_length())
    runs = docs.select(utf8(text).alias("text")).mapInArrow(_counter(shard_bits), "kind int, shard int, hashes binary, counts binary")
    return checkpoint(runs.groupBy("kind", "shard").applyInArrow(_merge(bits, probes), _MERGED)), shard_bits


def totals(shards: DataFrame, shard_bits: int) -> Totals:
    """From the sums of all shards, without the starts, which are no tokens."""

    def stored(wanted: np.uint64) -> int:
        row = shards.where((F.col("kind") == 1) & (F.col("shard") == int(shard_of(np.array([wanted]), shard_bits)[0]))).first()
        return int(counted(np.array([wanted]), np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["body"], f"u{row['width']}"))[0]) if row else 0

    sums = shards.where("kind = 1").agg(F.sum("total").alias("total"), F.sum("different").alias("different")).first()
    texts = stored(_END)
    return Totals((sums["total"] or 0) - stored(_START), (sums["different"] or 0) - (1 if texts else 0), texts)


def model(shards: DataFrame, shard_bits: int, known: Totals, probes: int = PROBES) -> Model:
    """All shards in one object, on the driver, which holds it once."""
    light = sorted(shards.select("kind", "shard", (F.octet_length("hashes") / 8).cast("long"), F.octet_length("body"), "width").collect())
    n = sum(r[2] for r in light)
    words, counts = np.zeros(n, np.uint64), np.zeros(n, np.uint64 if any(r[0] == 1 and r[4] == 8 for r in light) else np.uint32)
    starts, sizes = np.zeros(1 << shard_bits, np.int64), np.zeros(1 << shard_bits, np.uint64)
    filters, first, at, place = np.zeros(1 + sum(r[3] for r in light if r[0] == 2), np.uint8), {}, 0, 1
    for kind, shard, hashes, body, _ in light:
        if kind == 1:
            first[shard] = at
            at += hashes
        else:
            starts[shard], sizes[shard] = place, body * 8
            place += body
    for r in shards.toLocalIterator():
        if r["kind"] == 1:
            own = slice(first[r["shard"]], first[r["shard"]] + len(r["hashes"]) // 8)
            words[own], counts[own] = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["body"], f"u{r['width']}")
        else:
            filters[starts[r["shard"]] : starts[r["shard"]] + len(r["body"])] = np.frombuffer(r["body"], np.uint8)
    return Model(shard_bits, probes, known, words, counts, starts, sizes, filters)


def _struct(rows: list[list[np.ndarray]]) -> pa.StructArray:
    names = [x.split()[0] for x in _SCORES.split(", ")]
    columns = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64 if k < 2 else np.float64) for k in range(4)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names)


def score(docs: DataFrame, training: DataFrame, text: str = "text", most_bytes: int = MOST_BYTES, **options) -> DataFrame:
    """docs with a struct column `lm` (n_tokens, n_known, base_score, score) and a column `train_tokens`, in place of columns so called."""
    docs = docs.drop("lm", "train_tokens")
    shards, shard_bits = train(training, text, **options)
    known, probes = totals(shards, shard_bits), options.get("probes", PROBES)
    tokens = F.lit(known.tokens).cast("long").alias("train_tokens")
    size = shards.agg(F.sum(F.octet_length("hashes") + F.octet_length("body"))).first()[0] or 0
    if size > most_bytes:
        return _routed_scores(docs, shards, shard_bits, known, text, probes).select(*docs.columns, "lm", tokens)
    shared = docs.sparkSession.sparkContext.broadcast(model(shards, shard_bits, known, probes))

    @F.arrow_udf(f"struct<{_SCORES.replace(' ', ':').replace(',:', ',')}>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        for texts in batches:
            _, offsets = buffers(texts)
            yield _struct([held.totals.scores(*held.look_up(texts[a:b].to_pylist())) for a, b in spans(offsets, _CHUNK)])

    return docs.select("*", whole(utf8(text)).alias("lm"), tokens)


_ROUTED = "chunk long, kind int, shard int, body binary, pairs binary, starts binary, keys binary"
_ANSWERS = "chunk long, kind int, shard int, body binary"


def _requests(bits: int):
    """For each chunk of texts: a row (kind 0) of its tokens as places among its different words and pairs, and a row for each shard with its words (1) or pairs (2)."""
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _ROUTED.split(", ")]

    def rows(chunk: int, texts: list[bytes], keys: np.ndarray) -> Iterator[list]:
        numbers, starts, hashes = tokens_of(texts)
        key = (numbers[:-1] << 32) | numbers[1:]
        different, which = np.unique(key, return_inverse=True)
        pairs = pair_hash(hashes[different >> 32], hashes[different & 0xFFFFFFFF])
        places = []
        for kind, found, own in ((1, hashes, numbers), (2, pairs, which)):
            order = np.argsort(found, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            places.append(rank[own])
            found = found[order]
            shard = shard_of(found, bits)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(found) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield [chunk, kind, int(shard[a]), found[a:b].tobytes(), None, None, None]
        yield [chunk, 0, -1, places[0].tobytes(), np.r_[np.int32(0), places[1]].astype(np.int32).tobytes(), starts.tobytes(), keys.tobytes()]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = buffers(batch.column(0))
            keys = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            for a, b in spans(offsets, _CHUNK):
                found = list(rows(chunk, batch.column(0)[a:b].to_pylist(), keys[a:b]))
                chunk += 1
                for k in range(0, len(found), 64):
                    columns = zip(*found[k : k + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return route


def _routed_scores(docs: DataFrame, shards: DataFrame, bits: int, known: Totals, text: str, probes: int) -> DataFrame:
    """docs with `lm`, for a model of any size. Texts are named by two hashes of their content."""
    names = [fresh(docs, "_key0"), fresh(docs, "_key1")]
    keys = [F.xxhash64(utf8(text)), F.xxhash64(utf8(text), F.lit(1))]
    routed = checkpoint(docs.select(utf8(text).alias("text"), *[k.alias(n) for k, n in zip(keys, names, strict=True)]).mapInArrow(_requests(bits), _ROUTED))

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        field = np.zeros(0, np.uint8)
        for r in held.to_pylist():
            if r["kind"] == 1:
                words, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["body"], f"u{r['width']}")
            else:
                field = np.frombuffer(r["body"], np.uint8)
        found = []
        for kind, body in zip(asked["kind"].to_pylist(), asked["body"].to_pylist(), strict=True):
            h = np.frombuffer(body, np.uint64)
            sizes = np.full(len(h), len(field) * 8, np.uint64)
            found.append((counted(h, words, counts) if kind == 1 else probed(h, field, np.zeros(len(h), np.int64), sizes, probes)).tobytes())
        return pa.table([asked["chunk"], asked["kind"], asked["shard"], pa.array(found, pa.binary())], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    answers = routed.where("kind > 0").select(*[x.split()[0] for x in _ANSWERS.split(", ")]).groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(answer, _ANSWERS)

    def finish(key: tuple, tokens: pa.Table, found: pa.Table) -> pa.Table:
        r, got = tokens.to_pylist()[0], sorted(found.to_pylist(), key=lambda x: (x["kind"], x["shard"]))
        part = lambda kind, of: np.concatenate([np.frombuffer(x["body"], of) for x in got if x["kind"] == kind] or [np.zeros(0, of)])
        counts, levels, starts = part(1, np.int64), part(2, np.int8), np.frombuffer(r["starts"], np.int64)
        places, pairs = np.frombuffer(r["body"], np.int32), np.frombuffer(r["pairs"], np.int32)
        count, level = counts[places].copy(), levels[pairs].copy()
        count[starts] = level[starts] = 0
        key0, key1 = np.frombuffer(r["keys"], np.int64).reshape(-1, 2).T
        return pa.table([pa.array(key0), pa.array(key1), _struct([known.scores(count, level, starts)])], names=[*names, "lm"])

    kind = f"{names[0]} long, {names[1]} long, lm struct<{_SCORES.replace(' ', ':').replace(',:', ',')}>"
    scores = routed.where("kind = 0").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kind)
    each = checkpoint(scores.groupBy(*names).agg(F.first("lm").alias("lm")))
    return docs.withColumns(dict(zip(names, keys, strict=True))).join(each, names)
