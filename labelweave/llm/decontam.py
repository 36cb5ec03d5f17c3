"""Benchmark decontamination: latent semantic retrieval, then common subsequences and answer words.

Words (lower case, ASCII letters and digits and all other characters) are hashed to buckets; their
document frequencies come from all texts. Items are cut into passages of at most PASSAGE words. A
randomised SVD of the passages' TF-IDF rows, computed by Spark tasks, gives a latent basis. Every
text is cut into windows of WINDOW words, STRIDE words apart, so that a passage lies in one window
whole; windows and passages are folded into the latent space. A window also holds other words, which
bring its cosine with a passage down to the ratio of their lengths: it is a candidate if the cosine is
at least HELD times that ratio, and if passage words that carry SEEN of the passage's weight are in
the window at all.

A candidate puts the item somewhere in the text. There, a leak is where the longest common subsequence
of words, within twice the item's length, covers SHARE of the item, or LOOSE of it while the item's
ANSWER rarest words all stand there too (a paraphrase).

Items are the query set, searched in blocks of about BLOCK items, one after another: a block's searcher is broadcast, used and
destroyed before the next is made, so memory doesn't grow with the benchmark. The
basis is fitted on all passages. Items of under SHORT words have too little for a vector and
are found verbatim, by the hash of the whole run. Items of one or two words are no passage and match
nothing, as null and empty texts do; an empty benchmark or table gives no match; repeated rows match
each for themselves, and null ids are carried along. Texts are searched whole, in pieces of bounded
memory: what a text of any length needs at once is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import ALNUM, buffers, checkpoint, fresh, mix64, pieces, powers, remove, shared_folder, spans, utf8

#: Buckets (a power of two), latent dimensions, words in a window, between windows and in a passage (no more than WINDOW - STRIDE + 1).
BUCKETS, RANK, WINDOW, STRIDE, PASSAGE = 1 << 15, 128, 64, 16, 48
#: Least part of the cosine of a window that holds the whole passage; least part of a passage's weight whose words are in the window.
HELD, SEEN = 0.35, 0.4
#: Shares of an item's words in order; rare words of an answer; items under SHORT words are found verbatim, under LEAST not at all.
SHARE, LOOSE, ANSWER, SHORT, LEAST = 0.8, 0.5, 3, 8, 3
#: Items that are broadcast at once; bytes of text and numbers of a matrix handled at once; buckets whose lines one row of a fit carries.
BLOCK, _CHUNK, _SLAB, _LINES = 16384, 256 << 10, 4 << 20, 1024
#: Weight that a word in every text still has.
_FLOOR = 0.05
_TABLE = np.frombuffer(ALNUM, np.uint8)
MATCH = "array<struct<item:long,cosine:double,share:double,answer:boolean,word:long>>"
_MATCH = pa.list_(pa.struct([("item", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.bool_()), ("word", pa.int64())]))


def _piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = _TABLE[data]
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = raw != 32
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
    stops = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    up, down = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up, out=prefix[1:])
    return mix64((prefix[stops] - prefix[starts]) * down[starts]), np.searchsorted(offsets, starts, side="right") - 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a batch of texts, in order."""
    found = [(h, first + row) for first, some, at in pieces(data, offsets, _CHUNK) for h, row in [_piece_words(some, at)]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


def bucket_of(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (hashes >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)


def text_words(text: bytes) -> np.ndarray:
    return words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def document_frequencies(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """How many texts hold each bucket, how many each of some words (hashes in order), and how many texts there are."""
    words = np.zeros(0, np.uint64) if words is None else words
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        size = buckets + len(wanted)
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for first, last in spans(offsets, _CHUNK):
                hashes, rows = words_of(data, offsets[first : last + 1])
                keys = [rows * size + bucket_of(hashes, buckets)]
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    hit = wanted[at] == hashes
                    keys.append(rows[hit] * size + buckets + at[hit])
                key = np.sort(np.concatenate(keys))
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                total += np.bincount(key % size, minlength=size + 1)
                total[-1] += last - first
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counts = docs.select(utf8(text)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets + len(words) + 1, np.int64)
    total[counts["bucket"].to_numpy(int)] = counts["n"]
    return total[:buckets], total[buckets:-1], int(total[-1])


def vocabulary(items: DataFrame, text: str = "text") -> np.ndarray:
    """Hashes, in order, of the different words of all items; eight bytes each, on the driver."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": np.unique(np.concatenate([text_words(x) for x in batch["text"]] or [np.zeros(0, np.uint64)])).view(np.int64)})

    found = items.select(utf8(text).alias("text")).mapInPandas(cut, "h long").distinct().toPandas()["h"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def passages(words: np.ndarray, most: int = PASSAGE) -> list[tuple[int, np.ndarray]]:
    """(first word, words) of runs of about equal length, at most `most` words each."""
    count = -(-len(words) // most)
    cuts = [len(words) * k // count for k in range(count + 1)] if count else []
    return [(a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def latent_basis(items: DataFrame, idf: np.ndarray, text: str = "text", rank: int = RANK, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """Right singular vectors (buckets x rank) of all passages' TF-IDF rows, by randomised subspace iteration.

    Each round is a job: tasks multiply their rows with the current basis and back, the lines of the
    buckets that they met are added up in groups of _LINES buckets, and the driver, which gets a table
    of fixed size, orthogonalises. Equal passages are one row with a weight.
    """
    context = items.sparkSession.sparkContext
    buckets, width = len(idf), rank + 16

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"words": [w.tobytes() for value in batch["text"] for _, w in passages(text_words(value))]})

    rows = items.select(utf8(text).alias("text")).mapInPandas(cut, "words binary")
    rows = checkpoint(rows.groupBy("words").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("words")))
    tasks = min(256, max(8, rows.count() // 8192))  # what a task sends has a fixed size, however many rows it reads
    rows = checkpoint(rows.repartition(tasks, "h").sortWithinPartitions("h", "words").select("words", "n"))  # in an order of their own, so that sums of floats agree

    def gram(shared):
        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            basis = shared.value
            total, least = np.zeros((buckets, width), np.float32), b""
            for batch in batches:
                for value, n in zip(batch["words"], batch["n"], strict=True):
                    least = least or value
                    used, counts = np.unique(bucket_of(np.frombuffer(value, np.uint64), buckets), return_counts=True)
                    weights = counts * idf[used]
                    norm = np.sqrt((weights**2).sum())
                    if norm > 0:
                        weights = weights / norm
                        total[used] += np.outer(n * weights, weights @ basis[used])
            at = np.flatnonzero(total.any(1))
            for lines in np.split(at, np.flatnonzero(np.diff(at // _LINES)) + 1) if len(at) else ():
                yield pd.DataFrame({"lines": [int(lines[0]) // _LINES], "task": [least], "buckets": [lines.tobytes()], "part": [total[lines].tobytes()]})

        return multiply

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((_LINES, width))
        for own, part in parts.sort_values("task")[["buckets", "part"]].itertuples(index=False):
            total[np.frombuffer(own, np.int64) % _LINES] += np.frombuffer(part, np.float32).reshape(-1, width)
        return pd.DataFrame({"lines": [parts["lines"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    basis = np.random.default_rng(seed).standard_normal((buckets, width), np.float32)
    for number in range(rounds):
        shared, total = context.broadcast(basis), np.zeros((-(-buckets // _LINES) * _LINES, width), np.float32)
        parts = rows.mapInPandas(gram(shared), "lines int, task binary, buckets binary, part binary")
        for row in parts.groupBy("lines").applyInPandas(added, "lines int, part binary").toLocalIterator():
            total[row["lines"] * _LINES : (row["lines"] + 1) * _LINES] = np.frombuffer(row["part"], np.float32).reshape(-1, width)
        total = total[:buckets]
        shared.destroy()
        used = np.flatnonzero(total.any(1))  # only buckets of the items: the others' rows are zero
        if number < rounds - 1:
            basis = np.zeros((buckets, width), np.float32)
            own = np.linalg.qr(total[used])[0]
            basis[used, : own.shape[1]] = own
    values, turn = np.linalg.eigh(basis.T @ total)
    return basis @ turn[:, np.argsort(-values)[:rank]]


@dataclass(frozen=True)
class Searcher:
    """A block of items: their passages in the latent space, and what verifies candidates."""

    table: np.ndarray  # for each bucket and a last empty one: its latent weights
    latent: np.ndarray  # passages x rank, of length 1
    norms: np.ndarray  # their lengths before
    owners: np.ndarray  # for each passage: its item
    firsts: np.ndarray  # for each passage: its first word in the item
    weights: np.ndarray  # for each passage and word: its part of the passage's weight
    codes: np.ndarray  # for each passage and word: the number of its bucket among the buckets of passages, or -1
    known: np.ndarray  # for each bucket and the empty one: that number, or the last one
    places: list[dict[int, int]]  # for each item: words with the bits of their positions
    lengths: list[int]
    answers: list[frozenset]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # for each length of short items: hashes of whole runs in order, and the items

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """The leaks of each text."""
        hashes, rows = words_of(data, offsets)
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        starts = np.r_[0, np.cumsum(counts)]
        found: list[dict] = [{} for _ in counts]
        self._verbatim(hashes, rows, starts, found)
        if len(hashes) and len(self.latent):
            self._retrieved(hashes, counts, starts, found)
        return [[x[k] for k in sorted(x)] for x in found]

    def _verbatim(self, hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, found: list[dict]) -> None:
        for length, (runs, items) in self.short.items():
            if len(hashes) < length:
                continue
            own = run_hashes(hashes, length)
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            for k in np.flatnonzero((runs[at] == own) & (rows[: len(own)] == rows[length - 1 :])):
                row = int(rows[k])
                for item in items[runs == own[k]]:
                    found[row].setdefault(int(item), {"item": int(item), "cosine": 1.0, "share": 1.0, "answer": True, "word": int(k - starts[row])})

    def _retrieved(self, hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray, found: list[dict]) -> None:
        """Candidate windows, a slab at a time, and the verification of what they point at."""
        buckets, steps, rank = bucket_of(hashes, len(self.table) - 1), WINDOW // STRIDE, self.table.shape[1]
        windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1) * (counts > 0)
        blocks = np.where(windows > 0, windows + steps - 1, 0)
        first_block = np.r_[0, np.cumsum(blocks)]
        owner = np.repeat(np.arange(len(counts)), blocks)
        at = (np.arange(len(owner)) - first_block[owner]) * STRIDE  # first word of each block in its text
        slab = max(steps, _SLAB // max(rank * 2, len(self.latent)))
        seen: set[tuple[int, int, int]] = set()
        for low in range(0, len(owner), slab):
            high = min(low + slab + steps - 1, len(owner))
            word = at[low:high, None] + np.arange(STRIDE)
            inside = word < counts[owner[low:high], None]
            grid = np.where(inside, buckets[np.minimum(starts[owner[low:high], None] + word, len(buckets) - 1)], len(self.table) - 1)
            sums = np.zeros((len(grid), rank), np.float32)
            for column in grid.T:
                sums += self.table[column]
            n = len(grid) - steps + 1
            if n <= 0:
                break
            wide = sums[:n].copy()
            for k in range(1, steps):
                wide += sums[k : k + n]
            whole = owner[low : low + n] == owner[low + steps - 1 : low + steps - 1 + n]  # the window's blocks are of one text
            shadow = wide @ self.latent.T
            near = (shadow >= HELD * self.norms) & whole[:, None]
            window, passage = np.nonzero(near)
            keep = self._words_seen(grid, window, passage, steps)
            window, passage = window[keep], passage[keep]
            for w, p in zip(window.tolist(), passage.tolist(), strict=True):
                self._place(int(owner[low + w]), int(at[low + w]), p, float(shadow[w, p] / np.sqrt((wide[w] ** 2).sum())), hashes, starts, counts, found, seen)

    def _words_seen(self, grid: np.ndarray, window: np.ndarray, passage: np.ndarray, steps: int) -> np.ndarray:
        """Mask of the candidates whose window has words that carry SEEN of the passage's weight."""
        keep = np.zeros(len(window), bool)
        blank = int(self.known[-1])
        coded = self.known[grid]
        present = np.zeros(blank + 1, bool)
        for k in np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else ():
            same = slice(k, int(np.searchsorted(window, window[k], side="right")))
            own = coded[window[k] : window[k] + steps].ravel()
            present[own] = True
            present[blank] = False
            some = passage[same]
            keep[same] = (present[self.codes[some]] * self.weights[some]).sum(1) >= SEEN
            present[own] = False
        return keep

    def _place(self, row: int, at: int, passage: int, cosine: float, hashes, starts, counts, found: list[dict], seen: set) -> None:
        item = int(self.owners[passage])
        n = self.lengths[item]
        quantum = max(STRIDE, n // 4)
        begin = (at - int(self.firsts[passage])) // quantum  # where the item would start, if its words stood one after another
        if (row, item, begin) in seen:
            return
        seen.add((row, item, begin))
        low = max(0, begin * quantum - n // 2)
        high = min(int(counts[row]), begin * quantum + quantum + WINDOW + n + n // 2)
        share, answer, word = self.verify(item, hashes[starts[row] + low : starts[row] + high].tolist())
        if share >= SHARE or (share >= LOOSE and answer):
            best = found[row].get(item)
            if best is None or share > best["share"]:
                found[row][item] = {"item": item, "cosine": min(1.0, cosine), "share": share, "answer": answer, "word": low + word}

    def verify(self, item: int, words: list[int]) -> tuple[float, bool, int]:
        """Largest share of the item's words in a common subsequence within twice its length, whether its answer's words are there, and where."""
        masks, n = self.places[item], self.lengths[item]
        every, step = (1 << n) - 1, max(8, n // 2)
        best = (0.0, False, 0)
        for low in range(0, max(1, len(words) - n // 2), step):
            some = words[low : low + 2 * n + step]
            hits = [m for w in some if (m := masks.get(w))]
            if len(hits) < LOOSE * n:
                continue
            state = every
            for mask in hits:
                hit = state & mask
                state = ((state + hit) | (state & ~mask)) & every
            best = max(best, ((n - state.bit_count()) / n, self.answers[item] <= set(some), -low))
        return best[0], best[1], -best[2]


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of so many words."""
    total = np.zeros(len(hashes) - length + 1, np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
    return mix64(total)


def searcher(texts: list[bytes], idf: np.ndarray, basis: np.ndarray, known_words: np.ndarray, frequency: np.ndarray) -> Searcher:
    """The items of texts, with the weights of buckets, their latent basis, and the words of items and in how many texts each is."""
    table = np.zeros((len(idf) + 1, basis.shape[1]), np.float32)
    table[:-1] = basis * idf[:, None]
    vectors, owners, firsts, parts, places, lengths, answers = [], [], [], [], [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for number, text in enumerate(texts):
        hashes = text_words(text)
        if LEAST <= len(hashes) < SHORT:
            short.setdefault(len(hashes), []).append((int(run_hashes(hashes, len(hashes))[0]), number))
        elif len(hashes) >= SHORT:
            for first, words in passages(hashes):
                owners.append(number), firsts.append(first), parts.append(bucket_of(words, len(idf)))
                vectors.append(table[parts[-1]].sum(0))
        masks: dict[int, int] = {}
        for k, h in enumerate(hashes.tolist()):
            masks[h] = masks.get(h, 0) | 1 << k
        places.append(masks)
        lengths.append(max(1, len(hashes)))
        own = np.unique(hashes)
        order = np.lexsort((own, frequency[np.searchsorted(known_words, own)]))
        answers.append(frozenset(own[order[:ANSWER]].tolist()))
    latent = np.array(vectors, np.float32).reshape(len(owners), basis.shape[1])
    norms = np.linalg.norm(latent, axis=1)
    used = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    known = np.full(len(idf) + 1, len(used), np.int32)
    known[used] = np.arange(len(used))
    weights, codes = np.zeros((len(owners), PASSAGE), np.float32), np.full((len(owners), PASSAGE), len(used), np.int32)
    for k, part in enumerate(parts):
        energy = idf[part] ** 2
        weights[k, : len(part)] = energy / energy.sum()
        codes[k, : len(part)] = known[part]
    runs = {n: (np.array([h for h, _ in some], np.uint64), np.array([k for _, k in some])) for n, some in ((n, sorted(x)) for n, x in short.items())}
    latent = np.divide(latent, norms[:, None], out=np.zeros_like(latent), where=norms[:, None] > 0)
    return Searcher(table, latent, np.where(norms > 0, norms, 0).astype(np.float32), np.array(owners, np.int64), np.array(firsts, np.int64), weights, codes, known, places, lengths, answers, runs)


def _matches(spark: SparkSession, shared, text: str) -> Column:
    @F.arrow_udf(MATCH)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffers(texts)
            rows = []
            for a, b in spans(offsets, _CHUNK):
                rows += shared.value.search(data, offsets[a : b + 1])
            yield pa.array(rows, _MATCH)

    return match(utf8(text))


def searched(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block: int = BLOCK, rank: int = RANK) -> Iterator[tuple]:
    """(searcher, ids, last): a broadcast searcher for every block of items, the items' ids by their places in it, and whether it is the last.

    One block is made at a time: whoever asks for the next has destroyed the one before.
    """
    spark = docs.sparkSession
    items = checkpoint(benchmark.select(F.col(item_id).alias("item_id"), utf8(item_text).alias("text"), F.xxhash64(item_id, item_text).alias("h")))
    count = -(-items.count() // block)
    words = vocabulary(items)
    in_bucket, in_word, total = document_frequencies(docs, text, words=words)
    idf = np.log((total + 1) / (in_bucket + 0.5)).clip(_FLOOR).astype(np.float32)
    basis = latent_basis(items, idf, rank=rank)
    for number in range(count):
        rows = items.where(F.pmod("h", F.lit(count)) == number).orderBy("item_id", "h").collect()
        yield spark.sparkContext.broadcast(searcher([bytes(r["text"]) for r in rows], idf, basis, words, in_word)), [r["item_id"] for r in rows], number == count - 1


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each text and benchmark item that it leaks: key, item_id, cosine, share, answer, word. Blocks are searched one after another, each written to the shared folder."""
    spark, kind = docs.sparkSession, dict(benchmark.dtypes)[options.get("item_id", "item_id")]
    path = shared_folder(spark)
    columns = [key, "item_id", "cosine", "share", "answer", "word"]
    spark.createDataFrame([], f"`{key}` {dict(docs.dtypes)[key]}, item_id {kind}, cosine double, share double, answer boolean, word long").write.parquet(path)
    for shared, ids, _ in searched(docs, benchmark, text, **options):
        named = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        found = docs.select(F.col(key), F.explode(_matches(spark, shared, text)).alias("m")).select(key, "m.*")
        found.join(named, "item").select(*columns).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that leak no item, with all their columns. What a block leaves is written to the shared folder before the next block is made; the last is left to the caller."""
    spark, name = docs.sparkSession, fresh(docs, "_leaks")
    left, before = docs, None
    for shared, _, last in searched(docs, benchmark, text, **options):
        left = left.withColumn(name, F.size(_matches(spark, shared, text))).where(F.col(name) == 0).drop(name)
        if not last:
            path = shared_folder(spark)
            left.write.parquet(path)
            shared.destroy()
            left = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return left
