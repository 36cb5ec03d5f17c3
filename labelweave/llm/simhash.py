"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has 64 bits. Cut into six blocks, two fingerprints that differ in at most three bits
agree on at least three whole blocks, so they meet under one of the 20 keys made of three blocks
(32 bits or so). Keys are made once for each different fingerprint, however many texts share it.
What meets under a key is verified exactly; each key hands on a spanning forest of its links, not
all its pairs. A key with very many fingerprints is split into pairs of bounded chunks.

Null and empty texts have fingerprint zero and link like any other. Texts with fewer than three
words are one shingle. A null id never becomes a component's id unless all its ids are null.

Near copies (one_of_each) are the texts that agree on three blocks of the same fingerprints, and whose
shingle sets then have the exact Jaccard similarity asked for. Texts at that similarity whose fingerprints
differ in more bits than blocks allow for meet under keys of least hashes besides; they are verified alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import checkpoint, fresh, mix64, utf8
from labelweave.llm.components import components

#: Words in a shingle, bits that may differ, blocks of a fingerprint, fingerprints under one key that one task compares.
WORDS, DISTANCE, BLOCKS, CHUNK = 3, 3, 6, 1024
#: For near copies: words in a shingle, least Jaccard similarity, least hashes in a key and keys of a set, sets that one task compares.
#: Sets with a similarity of 0.8 share a key with probability 1 - (1 - 0.8^5)^20 = 0.9996.
NEAR_WORDS, SIMILARITY, KEY_HASHES, SET_KEYS, SET_CHUNK = 5, 0.8, 5, 20, 256
_SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 1 << 17


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """Hashes of all runs of so many words; shorter texts are one shingle, empty ones none."""
    tokens = text.lower().split()
    if not tokens:
        return []
    shingles = zip(*(tokens[k:] for k in range(words))) if len(tokens) >= words else [tokens]  # noqa: B905
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(x), _SEED) for x in shingles]


def fingerprint_of(text: bytes, words: int = WORDS, width: int = 1) -> list[int]:
    """The fingerprint as `width` signed 64-bit numbers; beyond the first they come from scrambled shingle hashes."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return [0] * width
    total, sums = 0, np.zeros((width, 8, 256), np.int64)
    for k in range(0, len(hashes), _STEP):
        part = np.array(hashes[k : k + _STEP], np.uint64)
        total += len(part)
        for w in range(width):
            places = part.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
            sums[w] += np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
            part = mix64(part + np.uint64(1))
    ones = (sums @ _BITS).reshape(-1)
    return np.packbits(2 * ones > total, bitorder="little").view(np.int64).tolist()


def fingerprint(text: str = "text", words: int = WORDS, width: int = 1) -> Column:
    """A column of fingerprints: arrays of `width` longs."""

    @F.arrow_udf("array<long>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_of(x.as_py(), words, width) for x in texts], pa.list_(pa.int64()))

    return prints(utf8(text))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[list[int]]:
    """For every choice of blocks that must agree: the mask of their bits. Any pair within the distance agrees under one."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [[_signed(sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in chosen))] for chosen in combinations(range(blocks), blocks - distance)]


def _forest(run: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (one, other) of links that span what is close within runs of equal keys."""
    left, right = [], []
    step, at = 1, np.flatnonzero(run[:-1] == run[1:])
    while len(at):
        close = np.bitwise_count(prints[at] ^ prints[at + step]).sum(1, dtype=np.int64) <= distance
        left.append(at[close])
        right.append(at[close] + step)
        step += 1
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
    return _spanned(left, right, len(run))


def _spanned(left: list[np.ndarray], right: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (root, other) that span the same components as all links between places."""
    label = np.arange(size)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(size))
    return label[moved], moved


def _linked(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(part):
            a, b = _forest(part[:, 0], part[:, 2:].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(part[a, 1]), pa.array(part[b, 1])], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            held = rows if held is None else np.concatenate([held, rows])
            other = np.flatnonzero(held[:, 0] != held[-1, 0]) if len(held) else ()
            if len(other):
                cut = int(other[-1]) + 1
                yield done(held[:cut])
                held = held[cut:]
        if held is not None and len(held) > 1:
            yield done(held)

    return link


def block_keys(fp: Column, masks: list[list[int]]) -> Column:
    """An array of keys of a fingerprint (an array of longs): one for each choice of blocks."""
    return F.array(*[F.xxhash64(F.lit(k), *[fp[w].bitwiseAND(F.lit(m)) for w, m in enumerate(mask)]) for k, mask in enumerate(masks)])


def links(nodes: DataFrame, masks: list[list[int]], distance: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes (node, fp) that connect all close fingerprints which agree under a mask; they may repeat."""
    width = len(masks[0])
    keys = block_keys(F.col("fp"), masks)
    columns = [F.col("fp")[w].alias(f"fp{w}") for w in range(width)]
    dealt = nodes.select("node", *columns, F.explode(keys).alias("run"))
    hot = checkpoint(
        nodes.select(F.explode(keys).alias("run")).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        .select("run", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    )
    if not hot.isEmpty():
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("run", F.least(j, own), F.greatest(j, own)))
        both = dealt.join(hot, "run", "left").withColumn("runs", F.when(F.col("chunks").isNull(), F.array("run")).otherwise(pairs))
        dealt = both.select("node", *[f"fp{w}" for w in range(width)], F.explode("runs").alias("run"))
    ordered = dealt.select("run", "node", *[f"fp{w}" for w in range(width)]).repartition("run").sortWithinPartitions("run")
    return ordered.mapInArrow(_linked(distance), "a long, b long")


def name_components(rows: DataFrame, masks: list[list[int]] | None = None, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id) for each different fp of rows (doc_key, fp); component_id is the smallest doc_key."""
    masks = masks or block_masks()
    node = F.col("fp")[0] if len(masks[0]) == 1 else F.xxhash64("fp")
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_key").alias("first")).withColumn("node", node))
    roots = components(links(nodes.select("node", "fp"), masks, distance)).withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, F.col("node") == F.col("linked"), "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    # A table of its own, so that the join's other side, where one root may have very many rows, can be split.
    smallest = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return rooted.join(smallest, "root").select("fp", "component_id")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Every row's key, 64-bit fingerprint `fp` and component_id, the smallest key of all rows that links lead to."""
    rows = checkpoint(docs.select(F.col(key).alias("doc_key"), fingerprint(text, words).alias("fp")))
    named = name_components(rows, block_masks(distance=distance), distance)
    return rows.join(named, "fp").select(F.col("doc_key").alias(key), F.col("fp")[0].alias("fp"), "component_id")


def shingle_set(text: bytes, words: int = NEAR_WORDS) -> np.ndarray:
    """Different shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


_FACTORS = mix64(np.arange(1, KEY_HASHES * SET_KEYS + 1, dtype=np.uint64)) | np.uint64(1)


def set_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set: each hashes the least members under KEY_HASHES scramblings. None for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, mix64(hashes[k : k + 1024, None] * _FACTORS).min(0))
    key = np.arange(SET_KEYS, dtype=np.uint64)
    for column in least.reshape(SET_KEYS, KEY_HASHES).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _set_columns(words: int):
    @F.arrow_udf("struct<node:long,fp:long,keys:array<long>>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bodies = [x.as_py() for x in texts]
            sets = [shingle_set(x, words) for x in bodies]
            nodes = pa.array([xxhash.xxh64_intdigest(x.tobytes(), _SEED) for x in sets], pa.uint64()).view(pa.int64())
            prints = pa.array([fingerprint_of(x)[0] for x in bodies], pa.int64())
            yield pa.StructArray.from_arrays([nodes, prints, pa.array([set_keys(x) for x in sets], pa.list_(pa.int64()))], ["node", "fp", "keys"])

    @F.arrow_udf("binary")
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(x.as_py(), words).tobytes() for x in texts], pa.binary())

    return named, members


def similar_sets(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places (one, other) of links that span all pairs of sets with at least that Jaccard similarity."""
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, left, right = np.zeros(len(codes), bool), [], []
    for k in range(len(sets) - 1):
        own, rest = codes[starts[k] : starts[k + 1]], slice(starts[k + 1], None)
        mark[own] = True
        shared = np.add.reduceat(mark[codes[rest]], starts[k + 1 : -1] - starts[k + 1], dtype=np.int64)
        mark[own] = False
        close = k + 1 + np.flatnonzero(shared >= similarity * (sizes[k] + sizes[k + 1 :] - shared) - 1e-9)
        left.append(np.full(len(close), k))
        right.append(close)
    return _spanned(left, right, len(sets))


def _verified(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, nodes, sets = None, [], []

        def done():
            a, b = similar_sets(sets, similarity)
            at = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[a]), pa.array(at[b])], ["a", "b"])

        for batch in batches:
            for key, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != run:
                    if len(sets) > 1:
                        yield done()
                    run, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(body, np.uint64))
        if len(sets) > 1:
            yield done()

    return verify


def set_links(nodes: DataFrame, texts: DataFrame, members: Column, similarity: float = SIMILARITY, chunk: int = SET_CHUNK) -> DataFrame:
    """Links (a, b) that connect all nodes (node, row, keys) which share a key and whose sets, made of texts (row, text), are similar.

    Nodes that meet under several keys without others are compared once. Where more than `chunk` nodes
    share a key, each pair of chunks is compared by itself.
    """
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    met = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    once = met.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
    runs = checkpoint(dealt.join(once, "key").select("node", F.explode(F.when(F.col("chunks") == 1, F.array("key")).otherwise(pairs)).alias("run")))
    wanted = nodes.join(runs.select("node").distinct(), "node", "left_semi").select("node", "row")
    sets = texts.join(wanted, "row").select("node", members.alias("members"))
    ordered = runs.join(sets, "node").select("run", "node", "members").repartition("run").sortWithinPartitions("run")
    return ordered.mapInArrow(_verified(similarity), "a long, b long")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = NEAR_WORDS, similarity: float = SIMILARITY, least: bool = True) -> DataFrame:
    """docs with one row of each component: that with the smallest key, nulls last; of repeated rows the first.

    Candidates are texts whose SimHash fingerprints agree on three blocks (so all within DISTANCE bits),
    and, unless `least` is off, those that share a key of least hashes. Candidates are linked if their
    sets of `words`-word shingles have a Jaccard similarity of at least `similarity`, which is computed
    on the sets themselves. Equal sets are one node. All columns stay as they are.
    """
    named, members = _set_columns(words)
    row = fresh(docs, "_row")
    numbered = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))  # a number is only good while rows keep it
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    made = numbered.select(first.alias("first"), named(utf8(text)).alias("s"))
    nodes = checkpoint(made.groupBy("s.node").agg(F.min("first").alias("first"), F.min_by("s.keys", "first").alias("keys"), F.collect_set("s.fp").alias("prints")))
    texts = numbered.select(F.col(row).alias("row"), F.col(text).alias("text"))
    # A set without a member has no key, and one node may have several fingerprints: a key counts once.
    blocks = F.flatten(F.transform("prints", lambda fp: block_keys(F.array(fp), block_masks())))
    keys = F.when(F.size("keys") > 0, F.array_distinct(F.concat("keys", blocks) if least else blocks)).otherwise(F.col("keys")).alias("keys")
    roots = components(set_links(nodes.select("node", "first.row", keys), texts, members(utf8("text")), similarity)).withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, F.col("node") == F.col("linked"), "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
