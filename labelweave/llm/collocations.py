"""Phrases that stick together, counted by vertically partitioned suffix trees.

The corpus is a string of words for each language, broken at piece ends; its suffixes, cut after
three words, are the tree's paths. As in ERA, the tree isn't built at once. Word prefixes are counted,
those with more suffixes than a quarter of the memory budget are extended by one word and counted
again, and the others are packed into groups of at most the budget. One scan of the texts then sends
every suffix to the group of its prefix: tasks send each different suffix with its number, so a
phrase that half the corpus repeats is one row a task. A group sorts its suffixes and reads the
subtree off neighbours: a node is a run of equal prefixes, its count the sum of its leaves.
Groups need nothing of each other. Only nodes above an extended prefix lie in several groups; their
parts are summed afterwards.

Bounds: the driver and every task hold the group of at most 2^23 hashed prefixes and at most as many
extended ones; a group holds at most BUDGET suffixes, more only beyond 2^42 words. Tasks number words
as they meet them and begin anew after 2^19 different ones.

Null texts are empty, a null language is `und`. A-Z become lower case. Texts without words give
nothing, and an empty table gives no row. Repeated rows count each time; a piece of any length is read in
slabs cut at blanks, with the last words carried over. Ties in score go to the higher count, then to the
phrase that is first in UTF-8 byte order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import buffers, checkpoint, mix64, powers, utf8

#: Words of a phrase at most; occurrences of a candidate at least; percentage of them inside one longer candidate that drops it; phrases of a language.
LONGEST, LEAST, INSIDE, FIRST = 3, 10, 50, 2000
#: Suffixes that one group holds in memory; prefixes that the driver may hold as hashes.
BUDGET, MOST_PREFIXES = 1 << 21, 1 << 23
_SLAB, _WORDS, _PENDING, _BLOCK = 1 << 20, 1 << 19, 1 << 20, 1 << 17
#: Lower case for A-Z, a byte that UTF-8 never has for what ends a piece, a blank for what ends a word.
_END = b"\xff"
_BYTES = bytes(b + 32 if 65 <= b < 91 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_EDGE = re.compile(rb"[ \xff]")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Numbering(dict):
    """Numbers words in order of appearance; no word is 0 and a piece's end 1."""

    def __init__(self):
        super().__init__({b"": 0, _END: 1})
        self.words = [b"", _END]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def slabs(data: bytes, size: int = _SLAB) -> Iterator[bytes]:
    """data in parts of about that size, cut before blanks or piece ends."""
    low = 0
    while low < len(data):
        found = _EDGE.search(data, min(low + size, len(data)))
        high = found.start() if found else len(data)
        yield data[low:high]
        low = high


def token_runs(data: bytes, size: int = _SLAB) -> Iterator[list[bytes]]:
    """Words and piece ends of prepared bytes, slab by slab; each run begins with the last two tokens of the one before, and two ends close the last."""
    left: list[bytes] = []
    for slab in slabs(data, size):
        run = left + slab.replace(_END, b" \xff ").split()
        yield run
        left = run[-2:]
    yield [*left, _END, _END]


def keys_of(ids: np.ndarray) -> np.ndarray:
    """One number for the three words from each place on but the last two: 21 bits a word, 0 from a piece's end on. Places that end a piece are left out."""
    a, b, c = ids[:-2], ids[1:-1].copy(), ids[2:].copy()
    b[b == 1] = 0
    c[(c == 1) | (b == 0)] = 0
    return ((a << 42) | (b << 21) | c)[a > 1]


def paths_of(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], 1)


def _runs(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a sorted array with their sums; counts None stand for ones."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first) if len(first) else n


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys and counts as one; the parts are let go."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    n = n[order]
    del order
    return _runs(keys, n)


def _prepared(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, bytes) of a batch (lang, text): the texts of each language in lower case, with one byte between words and another between pieces."""
    langs = np.array(batch.column(0).to_pylist(), object)
    raw, at = buffers(batch.column(1))
    for lang in dict.fromkeys(langs):
        yield lang, b"\n".join(raw[at[k] : at[k + 1]].tobytes() for k in np.flatnonzero(langs == lang)).translate(_BYTES)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, words by number, keys, counts) of an Arrow stream (lang, text), as often as a task's memory asks for."""
    numbers, fresh, held = Numbering(), {}, {}
    waiting, total = 0, 0
    for batch in batches:
        for lang, data in _prepared(batch):
            for run in token_runs(data):
                ids = np.fromiter(map(numbers.__getitem__, run), np.int64, len(run))
                if len(ids) > 2:
                    fresh.setdefault(lang, []).append(keys_of(ids))
                    waiting += len(fresh[lang][-1])
                if waiting > _PENDING:
                    total += _settle(fresh, held)
                    waiting = 0
                if len(numbers) > _WORDS or total > 2 * _PENDING:
                    yield from _handed(numbers, fresh, held)
                    numbers, fresh, held = Numbering(), {}, {}
                    waiting, total = 0, 0
    yield from _handed(numbers, fresh, held)


def _settle(fresh: dict, held: dict) -> int:
    """Sorts and counts what came last; how many different keys that makes."""
    total = 0
    for lang, parts in fresh.items():
        held.setdefault(lang, []).append(_runs(np.sort(np.concatenate(parts))))
        total += len(held[lang][-1][0])
    fresh.clear()
    return total


def _handed(numbers: Numbering, fresh: dict, held: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """What a task has met, language by language; the numbering and the parts are let go before they are used."""
    _settle(fresh, held)
    words = np.fromiter(numbers.words, object, len(numbers.words))
    numbers.clear(), numbers.words.clear()
    for lang in list(held):
        yield lang, words, *_merged(held.pop(lang))


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of prepared bytes, and the number of its piece: polynomials by prefix sums, no word is touched on its own."""
    blank = (data == 32) | (data == 255)
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    return (total[ends] - total[starts]) * down[starts], np.cumsum(data == 255)[starts]


def _seeded(hashes: np.ndarray, lang: str) -> np.ndarray:
    return mix64(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


#: The hash of no word, behind a piece's end; words that are hashed at once.
_NOTHING, _SOME = np.uint64(0x27D4EB2F165667C5), 1 << 16


def word_hashes(lang: str, words: np.ndarray | list[bytes]) -> np.ndarray:
    """A hash for each of a numbering's words, seeded by the language; no word and a piece's end have one too."""
    parts = [hashed_words(np.frombuffer(b" ".join(words[k : k + _SOME]), np.uint8))[0] for k in range(2, len(words), _SOME)]
    return np.r_[_NOTHING, _NOTHING, _seeded(np.concatenate(parts), lang) if parts else np.zeros(0, np.uint64)]


def prefix_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix from that of the prefix without its last word (0: none)."""
    return mix64(before * _STEP + word)


def prefix_hashes(hashes: np.ndarray, path: np.ndarray) -> np.ndarray:
    """rows x words of the path: the hash of each prefix, from that of the one before and its last word's."""
    out = np.zeros(path.shape, np.uint64)
    before = np.zeros(len(path), np.uint64)
    for k in range(path.shape[1]):
        before = out[:, k] = prefix_hash(before, hashes[path[:, k]])
    return out


@dataclass(frozen=True)
class Partition:
    """Where suffixes go: extended prefixes of one and of two words (sorted hashes), and the group of each range of hashes."""

    extended: tuple[np.ndarray, ...]
    groups: np.ndarray

    def long(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Whether prefixes of so many words are extended."""
        if size > len(self.extended) or not len(self.extended[size - 1]):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.extended[size - 1], hashes)
        return self.extended[size - 1][np.minimum(at, len(self.extended[size - 1]) - 1)] == hashes

    def group(self, hashes: np.ndarray) -> np.ndarray:
        """Groups of suffixes with the hashes of their prefixes."""
        chosen, going = hashes[:, 0].copy(), np.ones(len(hashes), bool)
        for size in range(1, hashes.shape[1]):
            going &= self.long(size, hashes[:, size - 1])
            chosen[going] = hashes[going, size]
        return self.groups[chosen >> np.uint64(64 - (len(self.groups) - 1).bit_length())] if len(self.groups) > 1 else np.zeros(len(hashes), np.int32)


def _prefix_counts(texts: DataFrame, size: int, shared) -> DataFrame:
    """(lang, h, n): how many suffixes begin with each prefix of `size` words whose shorter prefixes are all extended.

    Only hashes are counted: they say where suffixes go, not what they are. A prefix that a slab's end cuts counts as one that its piece ends.
    """

    def prefixes(lang: str, slab: bytes) -> np.ndarray:
        plain, piece = hashed_words(np.frombuffer(slab, np.uint8))
        word = _seeded(plain, lang)
        at = np.arange(len(word))
        h = prefix_hash(np.zeros(len(word), np.uint64), word)
        for k in range(1, size):
            long = shared.value.long(k, h)
            at, h = at[long], h[long]
            after = np.minimum(at + k, len(word) - 1)
            there = (at + k < len(word)) & (piece[after] == piece[at])
            h = prefix_hash(h, np.where(there, word[after], _NOTHING))
        return np.sort(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, n = _merged(parts)
                for low in range(0, len(h), _BLOCK):
                    some = h[low : low + _BLOCK].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[low : low + _BLOCK])], ["lang", "h", "n"])

        for batch in batches:
            for lang, data in _prepared(batch):
                for slab in slabs(data):
                    held.setdefault(lang, []).append(_runs(prefixes(lang, slab)))
                    total += len(held[lang][-1][0])
                    if total > 2 * _PENDING:
                        held = {x: [_merged(parts)] for x, parts in held.items()}
                        total = sum(len(h) for parts in held.values() for h, _ in parts)
                        if total > _PENDING:
                            yield from out()
                            held, total = {}, 0
        yield from out()

    return texts.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


def partition(texts: DataFrame, budget: int = BUDGET) -> tuple[Partition, DataFrame]:
    """The groups of the corpus, and (lang, n): all words of each language."""
    spark = texts.sparkSession
    extended: tuple[np.ndarray, ...] = ()
    loads, totals, bits = None, None, 10
    for size in range(1, LONGEST):
        shared = spark.sparkContext.broadcast(Partition(extended, np.zeros(1, np.int32)))
        counts = checkpoint(_prefix_counts(texts, size, shared))
        if totals is None:
            totals = checkpoint(counts.groupBy("lang").agg(F.sum("n").alias("n")))
            every = counts.agg(F.sum("n")).first()[0] or 0
            budget = max(budget, 4 * every // MOST_PREFIXES)
            while 1 << bits < 4 * every // budget:
                bits += 1
            loads = np.zeros(1 << bits, np.int64)
        often = F.col("n") > budget // 4
        light = counts.where(~often).groupBy(F.shiftrightunsigned("h", 64 - bits).alias("at")).agg(F.sum("n").alias("n")).toArrow()
        loads[light.column("at").to_numpy()] += light.column("n").to_numpy()
        extended += (np.sort(counts.where(often).select("h").toArrow().column("h").to_numpy().view(np.uint64)),)
        shared.destroy()
        if not len(extended[-1]):
            break
    return Partition(extended, packed(loads, budget)), totals


def packed(loads: np.ndarray, budget: int) -> np.ndarray:
    """A group for each place, in order: a new one begins where the load would pass the budget."""
    groups, group, held = np.zeros(len(loads), np.int32), 0, 0
    for k, load in enumerate(loads.tolist()):
        if held and held + load > budget:
            group, held = group + 1, 0
        held += load
        groups[k] = group
    return groups


def _compact(path: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a path uses, in order, and the path by their places."""
    if 8 * path.size < words:
        used = np.unique(path)
        return used, np.searchsorted(used, path)
    seen = np.zeros(words, bool)
    seen[path] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[path]


def _blocks(shared):
    """A task: its different suffixes as blocks (lang, grp, words, path, n) for the groups they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for lang, words, keys, n in gathered(batches):
            hashes = word_hashes(lang, words)
            group = np.zeros(len(keys), np.int32)
            for low in range(0, len(keys), _BLOCK):  # paths and their hashes take six times what keys take
                group[low : low + _BLOCK] = part.group(prefix_hashes(hashes, paths_of(keys[low : low + _BLOCK])))
            order = np.argsort(group, kind="stable")
            group = group[order]
            edges = np.unique(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), np.arange(0, len(group), _BLOCK), len(group)])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                used, own = _compact(paths_of(keys[order[low:high]]), len(words))
                row = [lang, int(group[low]), _END.join(words[used]), own.astype(np.int32).tobytes(), n[order[low:high]].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_TYPES, strict=True)], ["lang", "grp", "words", "path", "n"])

    return run


_BLOCK_TYPES = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def subtree(path: np.ndarray, n: np.ndarray, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(prefixes, counts) of the nodes at each depth of a group's tree that `wanted` (depth, prefixes, counts) marks, a block at a time.

    A node's count is the sum of its leaves. path is put in order in place; at no time are all nodes of a depth made.
    """
    small = path.max(initial=0) < 1 << 21
    if small:
        order = path[:, 0].astype(np.int64)
        for k in (1, 2):
            order <<= 21
            order |= path[:, k]
        order = np.argsort(order, kind="stable")
    else:
        order = np.lexsort(path.T[::-1])
    for k in range(path.shape[1]):
        path[:, k] = path[order, k]
    n = n[order]
    del order
    new = np.zeros(len(path), bool)
    for size in range(1, path.shape[1] + 1):
        new[:1] = True
        new[1:] |= path[1:, size - 1] != path[:-1, size - 1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at) if len(at) else n
        for low in range(0, len(at), _BLOCK):
            node, some = path[at[low : low + _BLOCK], :size], total[low : low + _BLOCK]
            there = (node[:, -1] != 0) & wanted(size, node, some)  # a suffix that ended before has no node here
            yield node[there], some[there]


def _trees(shared, least: int):
    """A task: blocks in order of group and language as phrases (lang, phrase, size, n), the frequent ones and all parts of extended prefixes."""

    def phrases(lang: str, blocks: list[tuple[bytes, pa.Buffer, pa.Buffer]]) -> Iterator[pa.RecordBatch]:
        part, numbers = shared.value, {b"": 0, _END: 1}
        path, n = np.zeros((sum(len(x[2]) for x in blocks) // 8, LONGEST), np.int32), np.zeros(sum(len(x[2]) for x in blocks) // 8, np.int64)
        low = len(n)
        while blocks:  # a block is let go when it is copied
            words, own, some = blocks.pop()
            own, some = np.frombuffer(own, np.int32).reshape(-1, LONGEST), np.frombuffer(some, np.int64)
            low -= len(some)
            path[low : low + len(some)] = np.array([numbers.setdefault(w, len(numbers)) for w in words.split(_END)], np.int32)[own]
            n[low : low + len(some)] = some
        words = np.fromiter(numbers, object, len(numbers))
        numbers.clear()
        hashes = word_hashes(lang, words)

        def wanted(size: int, node: np.ndarray, total: np.ndarray) -> np.ndarray:
            often = total >= least
            return often if size == LONGEST else often | part.long(size, prefix_hashes(hashes, node)[:, -1])

        for node, total in subtree(path, n, wanted):
            if len(node):
                some = [b" ".join(words[list(line)]) for line in node]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([node.shape[1]] * len(some), pa.int32()), pa.array(total)],
                    ["lang", "phrase", "size", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (grp.as_py(), lang.as_py(), (words.as_py(), path.as_buffer(), n.as_buffer()))  # one copy of a block's numbers is Arrow's
            for batch in batches
            for lang, grp, words, path, n in zip(*batch.columns, strict=True)
        )
        for (_, lang), own in itertools.groupby(rows, key=lambda r: r[:2]):
            yield from phrases(lang, [r[2] for r in own])

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of one to three words that occur `least` times, and (lang, n): all words of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"))
    part, totals = partition(texts, budget)
    shared = spark.sparkContext.broadcast(part)
    blocks = texts.mapInArrow(_blocks(shared), "lang string, grp int, words binary, path binary, n binary")
    grouped = blocks.repartition("grp").sortWithinPartitions("grp", "lang")
    nodes = grouped.mapInArrow(_trees(shared, least), "lang string, phrase string, size int, n long")
    whole = nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return checkpoint(whole), totals


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) of three columns below 10^15, exact: products are decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * cast(1000000 as decimal(7,0))) div ({wide(l)} * {wide(r)})")


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, inside): phrases of two and three words by their lowest cut, and the most that one longer phrase around them occurs.

    A node's own prefixes and suffixes are phrases as frequent as it, so all are in counts.
    """
    size = lambda n: counts.where(F.col("size") == n)
    head, tail = (lambda n: F.substring_index("phrase", " ", n)), (lambda n: F.substring_index("phrase", " ", -n))
    part = lambda n, at, names: size(n).select(F.col("lang"), F.col("phrase").alias(at), F.col("n").alias(names))
    pairs = size(2).select("lang", "phrase", F.col("n").alias("a"), head(1).alias("head"), tail(1).alias("tail"))
    pairs = pairs.join(part(1, "head", "l"), ["lang", "head"]).join(part(1, "tail", "r"), ["lang", "tail"])
    pairs = checkpoint(pairs.select("lang", "phrase", "a", "l", "r"))  # read thrice below
    triples = size(3).select("lang", "phrase", F.col("n").alias("a"), head(2).alias("head"), tail(2).alias("tail"))
    first = pairs.select("lang", F.col("phrase").alias("head"), F.col("l").alias("l1"), F.col("a").alias("l2"))
    last = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    triples = triples.join(first, ["lang", "head"]).join(last, ["lang", "tail"])
    around = triples.select("lang", "a", F.explode(F.array("head", "tail")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    cuts = triples.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    later = F.col("s2") < F.col("s1")
    longer = cuts.select(
        "lang", "phrase", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"), F.lit(0).cast("long").alias("inside"),
    )
    shorter = pairs.join(around, ["lang", "phrase"], "left").select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"), F.coalesce("inside", F.lit(0)).alias("inside"))
    return shorter.unionByName(longer)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE, first: int = FIRST, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    counts, totals = phrase_counts(docs, text, lang, least, budget)
    alone = candidates(counts).where(100 * F.col("inside") < inside * F.col("a")).drop("inside")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)  # no language is ranked in one task as a whole
    few = alone.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= first).drop("_r")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
