"""Rule-based quality: how much of a text lies in repeated word n-grams and repeated lines.

Words are mapped to numbers batch by batch; a polynomial rolling hash over 64-bit word values
gives the n-grams of every length from one prefix sum. Characters of overlapping n-grams count once. A text is kept if it passes the base rules
and the characters in duplicated n-grams and lines, and its symbols, stay below the limits.

Null and empty texts have no words: all counts are zero and the base rules fail. A repeated row is
judged like any other. Texts of any length are measured whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelweave.llm.common import BLANKS, CONTINUATION, mix64, utf8

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_fraction double, dup_gram_fraction double, top_gram_fraction double, reason string"
)
SYMBOLS = b"#*$%&|<>"
#: Words mapped to numbers before the map is started anew; three such numbers fit one 64-bit key.
_VOCABULARY = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters in duplicated lines, in duplicated n-grams, in the most frequent n-gram; symbols for each word."""

    lines: float = 0.40
    grams: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    top: dict[int, float] = field(default_factory=lambda: {2: 0.30, 3: 0.28, 4: 0.26})
    symbols: float = 0.2
    least_words: int = 50
    repeat_percent: int = 50


class _Vocabulary(dict):
    """Numbers words in order of appearance and remembers their lengths in code points."""

    def __init__(self):
        self.lengths: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.lengths.append(len(word) if word.isascii() else len(word.translate(None, CONTINUATION)))
        return number


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, inverse)])
        return self.up[:n], self.down[:n]


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that stand there twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Mask of the words inside the windows of n words that the mask of starts marks."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


class RepetitionMeter:
    """Measures one text after another; what is kept between texts doesn't change the results."""

    def __init__(self, limits: Limits):
        self.limits, self.vocabulary, self.powers = limits, _Vocabulary(), _Powers()

    def _exact_triples(self, ids: np.ndarray) -> np.ndarray:
        if len(self.vocabulary) < 1 << 21:
            return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        pair = np.unique(ids[:-2] * len(self.vocabulary) + ids[1:-1], return_inverse=True)[1]
        return pair * len(self.vocabulary) + ids[2:]

    def _hashes(self, ids: np.ndarray):
        values = mix64(ids.astype(np.uint64) + np.uint64(1))
        up, down = self.powers.upto(len(ids))
        prefix = np.r_[np.uint64(0), np.cumsum(values * up, dtype=np.uint64)]
        return lambda n: (prefix[n:] - prefix[:-n]) * down[: len(ids) - n + 1]

    def measure(self, text: bytes) -> tuple:
        words = text.split()
        n_words = len(words)
        if len(self.vocabulary) > _VOCABULARY:
            self.vocabulary = _Vocabulary()
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, n_words)
        n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        word_chars = len(text.translate(None, CONTINUATION + BLANKS))
        lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
        n_dup_lines = len(lines) - len(set(lines))
        repeated = int(covered(duplicated(self._exact_triples(ids)), 3, n_words).sum()) if n_words >= 3 else 0
        failed = n_words < self.limits.least_words or 100 * repeated > self.limits.repeat_percent * n_words
        line_part = self._line_fraction(lines, word_chars) if n_dup_lines else 0.0
        gram_part, top_part, reason = 0.0, 0.0, ""
        if n_words:
            gram_part, top_part, reason = self._grams(ids, word_chars)
        if line_part > self.limits.lines:
            reason = reason or "lines"
        if n_symbols > self.limits.symbols * n_words:
            reason = reason or "symbols"
        reason = "base" if failed else reason
        return n_words, word_chars, n_symbols, n_dup_lines, repeated, failed, not reason, line_part, gram_part, top_part, reason or None

    def _line_fraction(self, lines: list[bytes], word_chars: int) -> float:
        seen: dict[bytes, int] = {}
        for line in lines:
            seen[line] = seen.get(line, 0) + 1
        inside = sum(n * len(line.translate(None, CONTINUATION + BLANKS)) for line, n in seen.items() if n > 1)
        return inside / word_chars

    def _grams(self, ids: np.ndarray, word_chars: int) -> tuple[float, float, str]:
        hashes = self._hashes(ids)
        lengths = np.array(self.vocabulary.lengths, np.int64)[ids] if len(ids) * 8 > len(self.vocabulary) else np.fromiter(
            map(self.vocabulary.lengths.__getitem__, ids), np.int64, len(ids)
        )
        sums = np.r_[0, np.cumsum(lengths)]
        most_dup, most_top, reason = 0.0, 0.0, ""
        for n, limit in sorted(self.limits.top.items()):
            if len(ids) < 2 * n:
                break
            h = hashes(n)
            different, which, counts = np.unique(h, return_inverse=True, return_counts=True)
            if counts.max() < 2:
                break
            # The most frequent n-gram; of equally frequent ones that with the most characters.
            first = np.zeros(len(different), np.int64)
            first[which[::-1]] = np.arange(len(h))[::-1]
            chars = np.where(counts == counts.max(), sums[first + n] - sums[first], -1)
            share = lengths[covered(which == int(chars.argmax()), n, len(ids))].sum() / word_chars
            most_top = max(most_top, share)
            if share > limit:
                reason = reason or f"top_{n}"
        for n, limit in sorted(self.limits.grams.items()):
            if len(ids) <= n or not (twice := duplicated(hashes(n))).any():
                break  # longer n-grams can't repeat either
            share = lengths[covered(twice, n, len(ids))].sum() / word_chars
            most_dup = max(most_dup, share)
            if share > limit:
                reason = reason or f"dup_{n}"
        return float(most_dup), float(most_top), reason


def measure(text: str = "text", limits: Limits | None = None) -> Column:
    """A struct column of SCHEMA for a column of texts."""
    limits = limits or Limits()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")]

    @F.arrow_udf(SCHEMA)
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        meter = RepetitionMeter(limits)
        for texts in batches:
            rows = [meter.measure(x.as_py()) for x in texts]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rules(utf8(text))
