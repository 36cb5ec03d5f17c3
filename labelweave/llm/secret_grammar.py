"""Secret scans: base patterns, and formats learnt from the credentials that those find.

Labelled credentials (the values that the base patterns find anywhere in the corpus) become a
prefix tree for each kind; states whose outgoing frequencies agree within Hoeffding's bound are
merged, each with the state that explains it best, which leaves a probabilistic automaton. Its
transitions are smoothed by those of a background model: how often a symbol follows another in all
tokens of the credential alphabet in the corpus, outside base spans. Every such token of LEAST characters or more, with
or without digits, is then scored under each automaton, and so is every part of it from a separator
(`=`, `/` or `.`) or its start to a later separator or its end: keys stand in assignments, URLs and at
sentence ends. A candidate is reported if it is as likely as held-out credentials are (each half is held out once), and
more likely than under the background by MARGIN bits; of overlapping ones the one with most bits, then the first.
A part is at most twice as long as the longest credential; tokens as a whole may have any length.

Base spans always stay. A token that lies in a base span adds nothing; one that reaches beyond a base
span (a prefix and hexadecimal digits, say) is a span of its own if it is in a format.

Structure, frequencies, lengths and thresholds come from all different values of all texts, which stay where
they are: states are merged in rounds, and each round counts over the values. Null and empty texts
have no spans. Without credentials there are no automata, and only the base patterns count. Spans
are in code points, the end exclusive. Texts are scanned whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import checkpoint

# The base patterns, in the order of their kinds, with the least length of the value.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
FORMAT = "format"
#: Confidence of the merge test, share of held-out credentials that may score below the threshold.
CONFIDENCE, MISSED = 0.05, 0.02
#: Characters of a candidate at least; bits by which an automaton must explain it better than the background; weight of the background in a state.
LEAST, MARGIN, BLEND = 12, 12.0, 0.5
#: Bits by which another state must explain a tree better than the state that it hangs on: rare symbols say little about where they lead.
STAY = 10.0
#: What may stand beside a secret although credentials may hold it; parts of tokens are at most so many times as long as the longest credential.
SEPARATORS, STRETCH = "=/.", 2
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_ASSIGN = re.compile(PATTERNS["assign"][0], re.ASCII)
_ACCESS = re.compile(PATTERNS["access"][0])
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so that shorter ones need not be looked at
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")  # LEAST; runs are maximal
_BREAK = re.compile(r"[=/.]")  # SEPARATORS
#: Symbols of tokens, in the order of the background's rows and columns; the last row is a token's start, the last column its end.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_NUMBER = np.full(256, len(ALPHABET), np.int64)
_NUMBER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_EDGE = len(ALPHABET)
_CODES = bytes(_NUMBER.tolist())
_BOUND = math.sqrt(0.5 * math.log(2 / CONFIDENCE))


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of each base match, in order."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= PATTERNS["assign"][2]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= PATTERNS["access"][2]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """States with symbol and end frequencies; first a prefix tree, then merged. Of values in memory; merged_states() does it for tables."""

    def __init__(self, values: list[str]):
        self.seen, self.ends, self.next, self.uses = [0], [0], [{}], [{}]
        for value in values:
            state = 0
            self.seen[0] += 1
            for symbol in value:
                self.uses[state][symbol] = self.uses[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.seen)
                    self.seen.append(0), self.ends.append(0), self.next.append({}), self.uses.append({})
                state = self.next[state][symbol]
                self.seen[state] += 1
            self.ends[state] += 1

    def agree(self, a: int, b: int, bound: float) -> bool:
        """Whether two states, and those that both lead to, have frequencies within Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            room = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > room:
                return False
            for symbol in self.uses[a].keys() | self.uses[b].keys():
                if abs(self.uses[a].get(symbol, 0) / n - self.uses[b].get(symbol, 0) / m) > room:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys() if self.next[a][s] != self.next[b][s]]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds the frequencies of a tree to those of the states that read the same symbols."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for symbol, n in self.uses[b].items():
                self.uses[a][symbol] = self.uses[a].get(symbol, 0) + n
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
                else:
                    self.next[a][symbol] = self.next[b][symbol]

    def fit(self, state: int, tree: int) -> float:
        """log2-probability of all that follows in the tree, read from a state, each symbol and the end counted half more often.

        What the state doesn't lead to costs a bit more than any symbol would.
        """
        size = len(ALPHABET) + 1
        total, unknown = math.log2(self.seen[state]), -math.log2(2 * size)
        todo: list[tuple[int | None, int]] = [(state, tree)]
        while todo:
            a, b = todo.pop()
            if a is None:
                total += self.seen[b] * unknown
            else:
                n = self.seen[a] + size / 2
                total += sum(m * math.log2((self.uses[a].get(x, 0) + 0.5) / n) for x, m in self.uses[b].items())
                total += self.ends[b] * math.log2((self.ends[a] + 0.5) / n)
            todo += [(self.next[a].get(x) if a is not None else None, t) for x, t in self.next[b].items()]
        return total

    def merged(self, confidence: float = CONFIDENCE) -> list[dict]:
        """Merges compatible states; for each state left, its transitions, frequencies and end."""
        bound = math.sqrt(0.5 * math.log(2 / confidence))
        kept = [0]
        while True:
            fringe = [(s, x, t) for s in kept for x, t in sorted(self.next[s].items()) if t not in kept]
            if not fringe:
                break
            state, symbol, tree = max(fringe, key=lambda e: (self.seen[e[2]], -e[2]))
            match = max((r for r in kept if self.agree(r, tree, bound)), key=lambda r: (self.fit(r, tree) + STAY * (r == state), -r), default=None)
            if match is None:
                kept.append(tree)
            else:
                self.next[state][symbol] = match
                self.fold(match, tree)
        number = {s: k for k, s in enumerate(kept)}
        return [{"seen": self.seen[s], "end": self.ends[s], "to": {x: [number[t], self.uses[s][x]] for x, t in self.next[s].items()}} for s in kept]


def smoothed(states: list[dict], background: np.ndarray) -> list[dict]:
    """States with log2-probabilities for every symbol (`bits`) and for the end, blended with how often symbols come at all."""
    usual = background.sum(0) + 1.0
    usual /= usual.sum()
    out = []
    for s in states:
        n = s["seen"] + BLEND
        bits = {x: math.log2((s["to"].get(x, (0, 0))[1] + BLEND * usual[k]) / n) for k, x in enumerate(ALPHABET)}
        out.append({"bits": bits, "end": math.log2((s["end"] + BLEND * usual[_EDGE]) / n), "to": {x: t for x, (t, _) in s["to"].items()}})
    return out


def likelihood(states: list[dict], value: str) -> float:
    """log2-probability of the value's symbols and its end; an unseen symbol leads back to the start."""
    state, total = states[0], 0.0
    for symbol in value:
        total += state["bits"][symbol]
        state = states[state["to"].get(symbol, 0)]
    return total + state["end"]


def usual_bits(background: np.ndarray) -> np.ndarray:
    """log2-probability of each symbol after each, by the background's counts; every pair counts once more."""
    counts = background + 1.0
    return np.log2(counts / counts.sum(1, keepdims=True))


def background_likelihood(bits: np.ndarray, value: str) -> float:
    """log2-probability of the value's symbols and its end under the background."""
    at = _NUMBER[np.frombuffer(value.encode(), np.uint8)]
    return float(bits[np.r_[_EDGE, at], np.r_[at, _EDGE]].sum())


def credentials(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value) of every base match in docs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(KINDS[k], value) for x in batch.column(0) for _, k, _, value in base_matches(x.as_py() or "")]
            kinds, values = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    return docs.select(F.col(text)).mapInArrow(find, "kind string, value string")


def background(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each symbol follows each, with starts and ends, in all candidates of all texts: a table of fixed size."""
    size = _EDGE + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            texts = [x for x in batch.column(0).to_pylist() if x]
            found = [value for x in texts for _, _, value in candidates(x, base_matches(x))]
            raw = _NUMBER[np.frombuffer(("\0".join(["", *found, ""]) if found else "").encode(), np.uint8)]  # \0 is no symbol: an edge
            total += np.bincount(raw[:-1] * size + raw[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    counts = docs.select(F.col(text)).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size)
    table[counts["pair"].to_numpy(int)] = counts["n"]
    return table.reshape(size, size)


@dataclass(frozen=True)
class Formats:
    """Automata for the kinds of labelled credentials, and the background that they are held against."""

    models: list[dict]
    usual: np.ndarray

    def scores(self, value: str, free: Callable[[int, int], bool]) -> list[tuple[float, int, int]]:
        """(bits, start, end) of the value and its parts between separators that are free and in a format.

        Bits are those by which the best automaton that takes a part explains it better than the background.
        Each automaton is run once from each start, up to the longest part that may end there.
        """
        breaks = [m.start() for m in _BREAK.finditer(value)]
        size = len(value)
        at = _NUMBER[np.frombuffer(value.encode(), np.uint8)]
        usual = [0.0, *np.cumsum(self.usual[at[:-1], at[1:]]).tolist()]  # of the pairs before each place
        first, last = self.usual[_EDGE, at].tolist(), self.usual[at, _EDGE].tolist()
        found: dict[tuple[int, int], float] = {}
        for model in self.models:
            states, most = model["states"], max(STRETCH * model["longest"], LEAST)
            for start in [0, *[b + 1 for b in breaks]]:
                if size - start < model["length"]:
                    break
                limit = size if start == 0 else min(size, start + most)
                stops = {b for b in breaks[bisect.bisect(breaks, start) : bisect.bisect_right(breaks, start + most)] if b - start >= model["length"]}
                if limit == size:
                    stops.add(size)
                elif not stops:
                    continue
                state, total = states[0], 0.0
                for k in range(start, max(stops)):
                    total += state["bits"][value[k]]
                    state = states[state["to"].get(value[k], 0)]
                    if k + 1 in stops:
                        end, whole = k + 1, total + state["end"]
                        if whole / (end - start + 1) >= model["least"] and free(start, end):
                            bits = whole - (first[start] + usual[k] - usual[start] + last[k])
                            if bits >= MARGIN and bits > found.get((start, end), 0.0):
                                found[start, end] = bits
        return [(bits, a, b) for (a, b), bits in found.items()]

    def best(self, value: str, free: Callable[[int, int], bool] = lambda a, b: True) -> list[tuple[int, int, float]]:
        """(start, end, bits) of the best parts that don't overlap: most bits first, then the first one."""
        taken: list[tuple[int, int, float]] = []
        for bits, a, b in sorted(self.scores(value, free), key=lambda x: (-x[0], x[1], -x[2])):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, bits))
        return sorted(taken)


#: Automata of a kind: one for each half of its values, and one for all of them.
_PARTS, _ALL = 3, 2
#: What the hashes of paths are made with, modulo a prime.
_BASE, _PRIME = 0x1F3D5B79, (1 << 61) - 1
#: Fits are added up as integers, so that their order doesn't matter; thresholds are found in steps of these powers of two.
_FINE, _STEPS = 1 << 16, (6, 16, 26)

Counts = dict[int, dict[int, int]]


def _edge(state: int, symbol: int) -> int:
    """The number of the node that an undecided transition leads to; states have numbers from 0."""
    return -1 - (state * _EDGE + symbol)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(automaton, symbols) of each value, for both automata that learn from it."""
    for kind, half, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        codes = value.encode().translate(_CODES)
        yield kind * _PARTS + _ALL, codes
        yield kind * _PARTS + half, codes


def _exits(batch: pa.RecordBatch, drafts: dict[int, list[list[int]]]) -> Iterator[tuple[int, int, bytes]]:
    """(automaton, undecided transition, symbols after it) of each value that comes to one."""
    for model, codes in _each(batch):
        to, state = drafts[model], 0
        for k, x in enumerate(codes):
            ahead = to[state][x]
            if ahead < 0:
                yield model, _edge(state, x), codes[k + 1 :]
                break
            state = ahead


def _room(n: int, m: int) -> float:
    """Hoeffding's bound for frequencies among n and among m. At 1 or more nothing can exceed it."""
    return _BOUND * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _alike(a: dict[int, int], b: dict[int, int]) -> bool:
    n, m = sum(a.values()), sum(b.values())
    return all(abs(a.get(x, 0) / n - b.get(x, 0) / m) <= _room(n, m) for x in a.keys() | b.keys())


def _counted(values: DataFrame, drafts: dict[int, list[list[int]]]) -> dict[int, Counts]:
    """How often each symbol (or the end) follows each state, and each undecided transition, in all values of each automaton."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for model, codes in _each(batch):
                to, state = drafts[model], 0
                for k, x in enumerate(codes):
                    total[model, state, x] += 1
                    ahead = to[state][x]
                    if ahead < 0:
                        total[model, _edge(state, x), codes[k + 1] if k + 1 < len(codes) else _EDGE] += 1
                        break
                    state = ahead
                else:
                    total[model, state, _EDGE] += 1
        yield _rows([(*key, n) for key, n in total.items()], COUNTED)

    found: dict[int, Counts] = {}
    for r in values.mapInArrow(count, COUNTED).groupBy("model", "node", "symbol").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["model"], {}).setdefault(r["node"], {})[r["symbol"]] = r["n"]
    return found


COUNTED = "model int, node int, symbol int, n long"
EXITS = "model int, edge int, rest binary"
NODES = "model int, edge int, depth int, hash long, symbol int, n long"
PAIRS = "model int, edge int, depth int, hash long, state int, node int, depth_a int, hash_a long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _shared(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(automaton, transition, rest, depth that the row before shares, depth to look at) of ordered rows.

    A path that two rows of a batch share, they share with all rows between them. The first and the last row may
    share any path with other batches.
    """
    rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    before = 0
    for k, (model, edge, rest) in enumerate(rows):
        after = 0
        if k + 1 < len(rows) and rows[k + 1][:2] == (model, edge):
            other = rows[k + 1][2]
            most = min(len(rest), len(other))
            while after < most and rest[after] == other[after]:
                after += 1
        yield model, edge, rest, before, len(rest) if k in (0, len(rows) - 1) else max(before, after)
        before = after


def _hashes(rest: bytes, depth: int) -> list[int]:
    found = [0]
    for x in rest[:depth]:
        found.append((found[-1] * _BASE + x + 1) % _PRIME)
    return found


def _differing(values: DataFrame, drafts: dict[int, list[list[int]]], counts: dict[int, Counts], doubtful: dict[tuple[int, int], list[int]]) -> set[tuple[int, int, int]]:
    """(automaton, transition, state) whose frequencies differ anywhere below, beyond the bound.

    What follows an undecided transition is a prefix tree. Its nodes are counted by sorting what is left of the values:
    a node that one value alone reaches can't differ from anything. Each node is compared with what the same
    symbols lead to from each state in question: a state, or a node of this or another tree.
    """
    models = {model for model, _ in doubtful}
    seen = {model: {node: sum(c.values()) for node, c in counts[model].items()} for model in models}

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([row for row in _exits(batch, drafts) if row[0] in models], EXITS)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for model, edge, rest, _, deep in _shared(batch):
                found = _hashes(rest, deep)
                for d in range(1, deep + 1):
                    total[model, edge, d, found[d], rest[d] if d < len(rest) else _EDGE] += 1
            yield _rows([(*key, n) for key, n in total.items()], NODES)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for model, edge, rest, before, deep in _shared(batch):
                states = doubtful.get((model, edge), ())
                found = _hashes(rest, deep) if states and deep > before else []
                for first in states if found else ():
                    to, state, node, left = drafts[model], first, first, 0
                    for d in range(1, deep + 1):
                        if not left:
                            ahead = to[state][rest[d - 1]]
                            node, left = (ahead, 0) if ahead >= 0 else (_edge(state, rest[d - 1]), d)
                            state = ahead
                        if node not in seen[model] or _room(seen[model][edge], seen[model][node]) >= 1:
                            if left:
                                break
                            continue
                        if d > before:
                            deeper = d - left if left else 0
                            power = pow(_BASE, deeper, _PRIME)
                            rows.append((model, edge, d, found[d], first, node, deeper, (found[d] - found[left] * power) % _PRIME if deeper else 0))
            yield _rows(rows, PAIRS)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for model, edge, state, node, uses, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, theirs = Counter(), Counter()
                for u in uses:
                    mine[u["symbol"]] += u["n"]
                for u in other or ():
                    theirs[u["symbol"]] += u["n"]
                if not _alike(mine, counts[model][node] if other is None else theirs):
                    rows.add((model, edge, state))
            yield _rows(list(rows), "model int, edge int, state int")

    order = ("model", "edge", "rest")
    rest = values.mapInArrow(leave, EXITS).repartitionByRange(*order).sortWithinPartitions(*order)
    tree = (
        rest.mapInArrow(nodes, NODES).groupBy("model", "edge", "depth", "hash")
        .agg(F.sum("n").alias("seen"), F.collect_list(F.struct("symbol", "n")).alias("uses"))
        .where("seen > 1").drop("seen")
    )
    other = tree.select("model", F.col("edge").alias("node"), F.col("depth").alias("depth_a"), F.col("hash").alias("hash_a"), F.col("uses").alias("other"))
    met = (
        rest.mapInArrow(pairs, PAIRS).join(tree, ["model", "edge", "depth", "hash"])
        .join(other, ["model", "node", "depth_a", "hash_a"], "left")
        .where("depth_a = 0 or other is not null")
        .select("model", "edge", "state", "node", "uses", "other")
    )
    return {tuple(r) for r in met.mapInArrow(differ, "model int, edge int, state int").distinct().collect()}


def _fits(values: DataFrame, drafts: dict[int, list[list[int]]], counts: dict[int, Counts], usual: dict[int, Counts], wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], float]:
    """log2-probability of all that follows a transition, read from each state wanted.

    Each symbol and the end count half more often. Past an undecided transition one more symbol is known; those
    behind it cost what they do anywhere in the values.
    """
    size = _EDGE + 1

    def bits(uses: dict[int, int]) -> list[float]:
        n = sum(uses.values()) + size / 2
        return [math.log2((uses.get(x, 0) + 0.5) / n) for x in range(size)]

    models = {model for model, _ in wanted}
    known = {model: {node: bits(uses) for node, uses in counts[model].items()} for model in models}
    anywhere = {model: bits(usual[model][0]) for model in models}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for model, edge, rest in _exits(batch, drafts):
                if (model, edge) not in wanted:
                    continue
                to, tables, symbols = drafts[model], known[model], [*rest, _EDGE]
                left = np.cumsum([0.0, *[anywhere[model][x] for x in reversed(symbols)]])[::-1].tolist()
                for first in wanted[model, edge]:
                    state, found = first, 0.0
                    for k, x in enumerate(symbols):
                        found += tables[state][x]
                        if x == _EDGE:
                            break
                        ahead = to[state][x]
                        if ahead < 0:
                            node = _edge(state, x)
                            found += tables[node][symbols[k + 1]] + left[k + 2] if node in tables else left[k + 1]
                            break
                        state = ahead
                    total[model, edge, first] += round(found * _FINE)
        yield _rows([(*key, n) for key, n in total.items()], FITS)

    rows = values.mapInArrow(fit, FITS).groupBy("model", "edge", "state").agg(F.sum("fit").alias("fit")).collect()
    return {(r["model"], r["edge"], r["state"]): r["fit"] / _FINE for r in rows}


FITS = "model int, edge int, state int, fit long"


def _settle(edges: Counts, alive: dict[int, list[int]]) -> tuple[list[int], list[int]]:
    """Transitions to merge and those that become states, the most frequent first.

    One that may be merged with a new state waits, as does one less frequent than what a new state leads to.
    """
    merge, new, floor = [], [], 0
    for edge in sorted(edges, key=lambda e: (-sum(edges[e].values()), -e)):
        if edge not in alive or sum(edges[edge].values()) < floor or any(_alike(edges[n], edges[edge]) for n in new):
            continue
        if alive[edge]:
            merge.append(edge)
        else:
            new.append(edge)
            floor = max([floor, *[n for x, n in edges[edge].items() if x != _EDGE]])
    return merge, new


def merged_states(values: DataFrame) -> dict[int, list[dict]]:
    """Automata of all (kind, half, value), by number of kind times three plus half, or plus two for all values of the kind.

    As Automaton.merged() does it, for all automata at once, over values that stay where they are. The driver holds the states and the
    undecided transitions with their frequencies. In each round values are read up to their first undecided
    transition; transitions are then merged with the state that explains best what follows, or become states.
    """
    usual = _counted(values, {m: [[0] * _EDGE] for m in range(len(KINDS) * _PARTS)})
    drafts = {m: [[-1] * _EDGE] for m in range(len(KINDS) * _PARTS)}
    while True:
        counts = _counted(values, drafts)
        edges = {m: {node: c for node, c in counts[m].items() if node < 0} for m in counts}
        if not any(edges.values()):
            break
        alive = {m: {e: [r for r in range(len(drafts[m])) if _alike(counts[m][r], c)] for e, c in edges[m].items()} for m in edges}
        doubtful = {}
        for m in edges:
            most = max((sum(c.values()) for c in counts[m].values()), default=0)
            due = set(_settle(edges[m], alive[m])[0])
            for e in list(alive[m]):
                if alive[m][e] and _room(sum(edges[m][e].values()), most) < 1:
                    if e in due:
                        doubtful[m, e] = alive[m][e]
                    else:
                        del alive[m][e]
        for m, e, r in _differing(values, drafts, counts, doubtful) if doubtful else ():
            alive[m][e] = [s for s in alive[m][e] if s != r]
        chosen = {m: _settle(edges[m], alive[m]) for m in edges}
        wanted = {(m, e): alive[m][e] for m, (merge, _) in chosen.items() for e in merge if len(alive[m][e]) > 1}
        fits = _fits(values, drafts, counts, usual, wanted) if wanted else {}
        for m, (merge, new) in chosen.items():
            for e in merge:
                state, symbol = divmod(-1 - e, _EDGE)
                drafts[m][state][symbol] = max(alive[m][e], key=lambda r: (fits.get((m, e, r), 0.0) + STAY * (r == state), -r))  # noqa: B023
            for e in new:
                state, symbol = divmod(-1 - e, _EDGE)
                drafts[m][state][symbol] = len(drafts[m])
                drafts[m].append([-1] * _EDGE)
    return {
        m: [
            {"seen": sum(c.values()), "end": c.get(_EDGE, 0), "to": {ALPHABET[x]: [drafts[m][s][x], n] for x, n in c.items() if x != _EDGE}}
            for s, c in sorted(counts[m].items())
        ]
        for m in counts
    }


def _least(scored: DataFrame, ranks: dict[int, int]) -> dict[int, float]:
    """The score of each kind that so many others are below, rounded down to a multiple of 2^-26; all scores are counted, in ever finer steps."""
    at: dict[int, int] = {}
    left = dict(ranks)
    for k, step in enumerate(_STEPS):
        bins = scored.select("kind", F.floor(F.col("score") * (1 << step)).alias("bin"))
        if k:
            inside = [(F.col("kind") == kind) & (F.floor(F.col("bin") / (1 << (step - _STEPS[k - 1]))) == b) for kind, b in at.items()]
            bins = bins.where(reduce(lambda a, b: a | b, inside))
        done = set()
        for kind, b, n in bins.groupBy("kind", "bin").count().orderBy("kind", "bin").collect():
            if kind not in done:
                at[kind] = b
                if left[kind] < n:
                    done.add(kind)
                else:
                    left[kind] -= n
    return {kind: b / (1 << _STEPS[-1]) for kind, b in at.items()}


def automata(labelled: DataFrame, usual: np.ndarray) -> Formats:
    """An automaton for each kind of labelled (kind, value), from all different values, with the least likelihood and length of what is in its format."""
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    plain = F.col("value").rlike(r"\A[A-Za-z0-9+/_.=-]+\z")
    values = checkpoint(
        labelled.where(plain).select(number.cast("int").alias("kind"), "value").distinct()
        .select("kind", F.pmod(F.xxhash64("value"), F.lit(2)).cast("int").alias("half"), "value")
    )
    models = {m: smoothed(states, usual) for m, states in merged_states(values).items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, halves, found = (c.to_pylist() for c in batch.columns)
            held = [models.get(k * _PARTS + 1 - h, models[k * _PARTS + _ALL]) for k, h in zip(kinds, halves, strict=True)]
            scores = [likelihood(states, v) / (len(v) + 1) for states, v in zip(held, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(scores, pa.float64()), pa.array(list(map(len, found)), pa.int32())], ["kind", "score", "length"])

    scored = values.mapInArrow(score, "kind int, score double, length int")
    lengths: dict[int, list[tuple[int, int]]] = {}
    for r in scored.groupBy("kind", "length").count().orderBy("kind", "length").collect():
        lengths.setdefault(r["kind"], []).append((r["length"], r["count"]))
    ranks = {kind: int(MISSED * sum(n for _, n in found)) for kind, found in lengths.items()}
    least = _least(scored, ranks) if ranks else {}
    formats = []
    for kind in sorted(ranks, key=KINDS.__getitem__):
        below = np.cumsum([n for _, n in lengths[kind]])
        short = lengths[kind][int(np.searchsorted(below, ranks[kind], side="right"))][0]
        formats.append({"kind": KINDS[kind], "states": models[kind * _PARTS + _ALL], "least": least[kind], "length": max(LEAST, short), "longest": lengths[kind][-1][0]})
    return Formats(formats, usual_bits(usual))


def learn(docs: DataFrame, text: str = "text") -> Formats:
    """The formats of all credentials that the base patterns find in docs."""
    return automata(credentials(docs, text), background(docs, text))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) of every token that no base match covers."""
    at, covered = 0, 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] <= start:
            covered = max(covered, base[at][2])
            at += 1
        if end > covered:
            yield start, end, m[0]


def find_spans(text: str, formats: Formats) -> list[tuple[int, int, int, float | None]]:
    """(start, number of the kind, end, score) of base matches and of tokens in a learnt format, in order."""
    base = base_matches(text)
    spans = [(start, kind, end, None) for start, kind, end, _ in base]
    if formats.models:
        at, near = 0, []
        for start, end, value in candidates(text, base):
            while at < len(base) and base[at][0] < end:
                near.append(base[at])
                at += 1
            near = [m for m in near if m[2] > start]
            free = lambda a, b: not any(m[0] <= start + a and start + b <= m[2] for m in near)  # noqa: B023, E731
            spans += [(start + a, len(KINDS), start + b, bits) for a, b, bits in formats.best(value, free)]
    return sorted(spans, key=lambda s: s[:3])


def scan(df: DataFrame, formats: Formats, text: str = "text") -> Column:
    """A column of SPANS for the texts of df."""
    shared = df.sparkSession.sparkContext.broadcast(formats)
    names = (*KINDS, FORMAT)

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for texts in batches:
            rows = [
                [{"kind": names[k], "start": a, "end": b, "score": score} for a, k, b, score in find_spans(x.as_py(), shared.value)] for x in texts
            ]
            yield pa.array(rows, kind)

    return spans(F.coalesce(F.col(text), F.lit("")))


def redact(docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def clean(value: str) -> str:
        parts, at = [], 0
        for start, kind, end, _ in find_spans(value, shared.value):
            if end > at:
                parts += [value[at : max(at, start)], f"<{(*KINDS, FORMAT)[kind]}>" if start >= at else ""]
                at = end
        return "".join([*parts, value[at:]]) if parts else value

    @F.arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if (v := x.as_py()) is None else clean(v) for x in texts], pa.string())

    return docs.withColumn(text, redacted(F.col(text)))
