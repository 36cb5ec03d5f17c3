"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text above CHUNK bytes is cut into chunks that reach ZONE bytes beyond each cut, so neighbours
overlap; chunks are dealt over all tasks and encoded with offsets. A place in an overlap is where two
chunks may be spliced if it is a token's end in both encodings and if it is proven stable: there the
tokenizer's own pattern ends a match whatever stands before or behind (a letter, digit, sign or mark
before an ASCII blank, or a letter or digit before a mark), and it lies in no added token's string. Left of
such a place neither encoding depends on what is right of it, and the other way round, so the tokens of a
text are those of each chunk between its two splices. An overlap without a proven place is widened,
doubling up to half a chunk; where that fails too, the cut is given up and the two chunks are one, so
a text without any stable place is encoded whole.

Shorter texts are encoded whole: they are cut at stable places (blanks behind what is none) and each
different stretch is encoded once a task, as long as 32 MB hold them. Both need a byte-level tokenizer
without normaliser whose added tokens have no blanks and strip nothing; other tokenizers encode every
text whole, which gives the library's counts as well.

The vocabulary is a tokenizers file (.json) or a sentencepiece model (.model), read by the driver and
broadcast; its size is checked. No begin, end or added special tokens are set, nothing is cut off or padded;
special strings inside texts are what the library takes them for. Null and empty texts have no token.
Bytes that are no UTF-8 count as the replacement character does. Repeated rows count each time, and
columns other than the text are handed on or ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import buffers

#: Bytes between two cuts, and bytes that chunks reach beyond a cut at first.
CHUNK, ZONE = 32 << 10, 256
#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20
#: Bytes of different stretches that a task remembers.
_REMEMBER = 32 << 20
_UNIT = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: UTF-8 of what some pattern may call a blank besides the four above, and controls: texts with them aren't cut into stretches.
_ODD = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf")


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, and whether stable places in its texts can be proven."""

    kind: str
    content: bytes
    added: tuple[str, ...]
    provable: bool


def read_vocabulary(path: str) -> Vocabulary:
    """The tokenizer at a path that the driver can open."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes; it would be too large to broadcast")
    with open(path, "rb") as file:
        content = file.read()
    if path.endswith(".model"):
        return Vocabulary("sentencepiece", content, (), False)
    said = json.loads(content)
    added = said.get("added_tokens") or []
    before = said.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not said.get("normalizer")
    bare = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or not t["content"] for t in added)
    return Vocabulary("tokenizers", content, tuple(t["content"] for t in added), bool(plain and bare))


class Encoder:
    """One worker's tokenizer."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.held = vocabulary, {}, 0
        if vocabulary.kind == "sentencepiece":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.content)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(vocabulary.content.decode())
        self.library.no_truncation()
        self.library.no_padding()

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text, encoded whole."""
        texts = [t.decode("utf-8", "replace") for t in texts]
        if self.vocabulary.kind == "sentencepiece":
            return [len(x) for x in self.library.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
        return [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def count(self, text: bytes) -> int:
        """Tokens of a text, by its stretches where they can be proven independent."""
        if not text:
            return 0
        if not self.vocabulary.provable or _ODD.search(text):
            return self.lengths([text])[0]
        stretches = _UNIT.findall(text)
        try:
            return sum(map(self.known.__getitem__, stretches))
        except KeyError:
            pass
        if self.held > _REMEMBER:
            self.known, self.held = {}, 0
        new = list(set(stretches).difference(self.known))
        self.known.update(zip(new, self.lengths(new), strict=True))
        self.held += sum(map(len, new)) + 100 * len(new)
        return sum(map(self.known.__getitem__, stretches))

    def ends(self, text: str) -> np.ndarray:
        """Where the tokens of a text end, in code points."""
        return np.array([end for _, end in self.library.encode(text, add_special_tokens=False).offsets], np.int64)


def proven(window: str, added: tuple[str, ...] = ()) -> list[int]:
    """The places in a window (before which character) where every encoding of a text that holds it has a boundary.

    Places nearer to the window's edges than the longest added token aren't proven: its string may begin or end beyond them.
    """
    margin = max((len(x) for x in added), default=0)
    low, high = max(1, margin), len(window) - max(1, margin)
    found = []
    for k in range(low, high + 1):
        here = window[k] if k < len(window) else ""
        if not here:
            continue
        before = unicodedata.category(window[k - 1])[0]
        if here in " \t\n\r":
            if before in "LNPS":
                found.append(k)
        elif before in "LN" and unicodedata.category(here)[0] == "P":
            found.append(k)
    for token in added if found else ():
        at = window.find(token)
        while at >= 0:
            found = [k for k in found if not at < k < at + len(token)]
            at = window.find(token, at + 1)
    return found


def _align(data: bytes, at: int) -> int:
    """The first place from `at` on that is inside no UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def zones(data: bytes, vocabulary: Vocabulary, chunk: int, zone: int) -> list[tuple[int, int]]:
    """The overlaps of neighbouring chunks, each wide enough to hold a proven place; none where the next cut would be."""
    found = []
    for cut in range(chunk, len(data), chunk):
        reach = zone
        while True:
            low, high = _align(data, max(0, cut - reach)), _align(data, min(len(data), cut + reach))
            if proven(data[low:high].decode("utf-8", "replace"), vocabulary.added):
                found.append((low, high))
                break
            if reach >= chunk // 2:
                break
            reach = min(2 * reach, chunk // 2)
    return found


def _cut(vocabulary: Vocabulary, chunk: int, zone: int):
    """A task: rows (kept, row, text) as chunks, with the overlaps at their ends; the last chunk of a text carries what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows, texts = batch.columns
            for i, row in enumerate(rows.to_pylist()):
                data = texts[i].as_py()
                overlaps = zones(data, vocabulary, chunk, zone)
                for k in range(len(overlaps) + 1):
                    left = overlaps[k - 1] if k else (0, 0)
                    right = overlaps[k] if k < len(overlaps) else (len(data), len(data))
                    last = k == len(overlaps)
                    one = [row, k, last, left[0], left[1], right[0], right[1], data[left[0] : right[1]]]
                    yield pa.RecordBatch.from_arrays([kept.slice(i, 1) if last else pa.nulls(1, kept.type), *[pa.array([x]) for x in one]], ["kept", *_CHUNK])

    return run


_CHUNK = {"row": "long", "number": "long", "last": "boolean", "left_low": "long", "left_high": "long", "right_low": "long", "right_high": "long", "piece": "binary"}
_SIDE = {"row": "long", "cut": "long", "sign": "int", "at": "array<long>", "rank": "array<long>"}


def _schema(kept: str, columns: dict[str, str]) -> str:
    return ", ".join([f"kept {kept}", *[f"{n} {t}" for n, t in columns.items()]])


def _byte_at(text: str) -> np.ndarray:
    """The byte that each character begins at, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]


def _sides(ends: np.ndarray, text: str, byte_at: np.ndarray, start: int, overlap: tuple[int, int], added: tuple[str, ...]) -> tuple[list[int], list[int]]:
    """The places of an overlap, in bytes of the whole text, where a piece that begins at `start` may be spliced, and its tokens before each."""
    low, high = np.searchsorted(byte_at, [overlap[0] - start, overlap[1] - start])
    places = [int(low) + k for k in proven(text[low:high], added)]
    rank = np.searchsorted(ends, places, side="right")
    kept = [(int(byte_at[p]) + start, int(r)) for p, r in zip(places, rank, strict=True) if r and ends[r - 1] == p]
    return [p for p, _ in kept], [r for _, r in kept]


def _encoded(shared):
    """A task: for each chunk the splices at its ends; the end of a text is its cut -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            rows, carried = [], []
            for i, c in enumerate(batch.drop_columns(["kept"]).to_pylist()):
                text = c["piece"].decode("utf-8", "replace")
                ends, byte_at = encoder.ends(text), _byte_at(text)
                look = lambda a, b: _sides(ends, text, byte_at, c["left_low"], (a, b), shared.value.added)  # noqa: B023, E731
                if c["number"]:
                    rows.append((c["row"], c["number"], -1, *look(c["left_low"], c["left_high"])))
                rows.append((c["row"], -1, 1, [c["right_high"]], [len(ends)]) if c["last"] else (c["row"], c["number"] + 1, 1, *look(c["right_low"], c["right_high"])))
                carried += [None] * (c["number"] > 0) + [i if c["last"] else None]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            kept = batch.column("kept").take(pa.array(carried, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)]], ["kept", *_SIDE])

    return run


def spliced(edges: DataFrame) -> DataFrame:
    """(row, kept, n_tokens) of the sides of all cuts: each cut adds the tokens left of its splice and takes away those that the right chunk has before it."""
    side = lambda sign: F.first(F.when(F.col("sign") == sign, F.struct("at", "rank")), ignorenulls=True)
    cuts = edges.groupBy("row", "cut").agg(side(1).alias("l"), side(-1).alias("r"), F.first("kept", ignorenulls=True).alias("kept"))
    place = F.get(F.array_intersect("l.at", "r.at"), F.lit(0))
    rank = lambda s: F.element_at(f"{s}.rank", F.array_position(f"{s}.at", F.col("place")).cast("int"))
    parts = cuts.withColumn("place", place).select(
        "row",
        "kept",
        F.when(F.col("cut") < 0, F.col("l.rank")[0])
        .when(F.col("place").isNotNull(), rank("l") - rank("r"))
        .otherwise(F.raise_error(F.lit("two encodings of an overlap share no stable place"))).alias("part"),
    )
    return parts.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.sum("part").alias("n_tokens"))


def count(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, zone: int = ZONE) -> DataFrame:
    """Columns `keep` of docs with `n_bytes` and `n_tokens` of the text; columns so called that docs has must not be in `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = F.octet_length(data)
    huge = (size > chunk) if vocabulary.provable else F.lit(False)

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for texts in batches:
            whole, at = buffers(texts)
            yield pa.array([encoder.count(whole[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    out = [*keep, size.cast("long").alias("n_bytes")]
    short = docs.where(~huge).select(*out, tokens(data).alias("n_tokens"))
    if not vocabulary.provable:
        return short
    large = docs.where(huge).select(F.struct(*out).alias("kept"), F.monotonically_increasing_id().alias("row"), data.alias("raw"))
    kept = large.schema["kept"].dataType.simpleString()
    chunks = large.mapInArrow(_cut(vocabulary, chunk, zone), _schema(kept, _CHUNK))
    dealt = chunks.repartition("row", "number")  # the chunks of a text go to many tasks
    counted = spliced(dealt.mapInArrow(_encoded(shared), _schema(kept, _SIDE)))
    return short.unionByName(counted.select("kept.*", "n_tokens"))
