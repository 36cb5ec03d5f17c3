"""Token counts, hard negatives and collocations over nulls, empty and long texts, repeats, ties and clashing columns, against plain Python."""

import collections
import json
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.llm import collocations, hard_negatives, queries, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _texts(rng):
    """Texts whose places to splice are many, few and none, with special strings, odd blanks and characters of several bytes."""
    pieces = ["the", " house", "'s", "don't", "  ", "\n\n", "\t", "é", "漢字", "。", "😀", " ", " ", "　", "12345", "...", "<|endoftext|>", "<|endof", "text|>", "\r\n", " x", "'", "’s", "\x00", "\x1c", "ﬁ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["a" * 5000, "漢字" * 900, " " * 3000, "<|endoftext|>" * 300, "　" * 900, "ab " * 2000 + "c" * 3000 + " d" * 2000, "x" * 700 + " " + "y" * 700]
    return texts


@pytest.mark.parametrize("chunk, zone", [(512, 16), (700, 64), (64, 8)])
def test_token_counts_are_the_librarys(spark, vocabulary, library, chunk, zone):
    texts = _texts(random.Random(chunk))
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (7, ""), (7, texts[7])], "doc_id long, text string").repartition(5)
    got = collections.Counter(map(tuple, token_counts.count(docs, vocabulary, chunk=chunk, zone=zone).collect()))
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (None, None), (7, ""), (7, texts[7])])
    assert got == want


def test_overlaps_widen_and_cuts_without_a_stable_place_are_given_up(vocabulary):
    data = ("ab " * 100 + "c" * 250 + " d" * 200).encode()
    found = token_counts.zones(data, vocabulary, 256, 16)
    assert found[0] == (240, 272) and len(found) == len(data) // 256
    wide = [b - a for a, b in found]
    assert max(wide) > 32 and token_counts.zones(b"a" * 5000, vocabulary, 256, 16) == []
    assert token_counts.proven("word <|endoftext|> word, and more words", vocabulary.added)
    assert all(not 5 < k < 18 for k in token_counts.proven("word <|endoftext|> word, and more words than that", vocabulary.added))


def test_token_counts_of_other_tokenizers(spark, nasty, empty, vocabulary, library):
    kept = token_counts.count(nasty, vocabulary, keep=tuple(nasty.columns), chunk=4096)
    assert kept.columns == [*nasty.columns, "n_bytes", "n_tokens"] and kept.count() == nasty.count()
    for r in kept.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count(empty, vocabulary).count() == 0
    import sentencepiece
    import tokenizers

    texts = ["Hello  World, déjà", "", "漢字 and <s> more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    word = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for name, size in (("piece_bpe_32k.model", lambda t: len(piece.encode(t))), ("word_bpe_49k.json", lambda t: len(word.encode(t, add_special_tokens=False).ids))):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(docs, token_counts.read_vocabulary(public_tokenizers.path(name))).collect()}
        assert got == {k: size(t) for k, t in enumerate(texts)}


def _negatives(rows, positives=5, negatives=10):
    """Brute force over rows (vec_id, vector, label); the label is the changed one."""
    part = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: math.inf if i is None else i
    out = []
    for a, (i, v, l) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(j), j, m) for b, (j, w, m) in enumerate(part) if b != a), key=lambda s: s[:2])
        for s, _, j, _ in [x for x in scored if x[3] == l][:positives]:
            allowed = [(n, t) for t, _, n, m in scored if m != l and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (n, t) in enumerate(allowed)]
    return collections.Counter(out)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rng = random.Random(block)
    rows = [(k * 10, [round(rng.uniform(-0.3, 1), 1) for _ in range(4)], rng.randint(0, 2)) for k in range(150)]  # few different scores: many ties
    rows += [(100, rows[10][1], rows[10][2])] * 2 + [(None, [0.5] * 4, 1), (None, [0.9] * 4, 0), (3000, None, 1), (3100, [1.0] * 4, None), (3200, [1.0, None, 0.0, 0.0], 1)]
    rows += [(3300, [math.nan] * 4, 1), (3400, [math.inf] * 4, 1), (3500, [], 1), (3600, [1.0, 1.0], 1), (3700, [0.3] * 9, 0), (3800, [-0.4] * 4, 2)] + [(7, [0.8] * 4, 2)] * 40
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string").repartition(6)
    got = collections.Counter(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()))
    assert got == _negatives(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table, F.col("vec_id") == 5).count() == 0


def test_hard_negatives_of_huge_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(k * 50, [rng.uniform(-1, 1) * 2.0**21 for _ in range(5)], k % 2) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collections.Counter(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 100 == 0).collect()))
    assert got == _negatives(rows) and got
    wide = [(k * 50, [2.0**60 * (k + 1)], k % 2) for k in range(6)]  # beyond long: scores end at its limit
    assert hard_negatives.mine(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0).count() == 0


def test_slots_keep_the_first_rows_in_any_order():
    rng = np.random.default_rng(5)
    for k in (1, 3):
        top = hard_negatives.TopSlots(4, 2, k)
        rows = [(int(rng.integers(4)), int(rng.integers(2)), int(rng.integers(-3, 4)), i) for i in range(300)]
        rng.shuffle(rows)
        for low in range(0, len(rows), 17):
            top.add(*np.array(rows[low : low + 17]).T)
        batch = top.batch().to_pylist()
        for a in range(4):
            for s in range(2):
                want = sorted((-r[2], r[3]) for r in map(tuple, rows) if (r[0], r[1]) == (a, s))[:k]
                assert [(-r["score"], r["id"]) for r in batch if (r["anchor"], r["slot"]) == (a, s)] == want


def _phrases(rows, least=10, inside=50, first=2000):
    """Brute force over rows (text, lang)."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    lower = {k: k + 32 for k in range(65, 91)}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(" ".join(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < least:
                continue
            cuts = [(1000000 * a * a // (f[" ".join(words[:k])] * f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((-score, -a, phrase.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        around = collections.Counter()
        for _, a, phrase, *_ in found:
            words = phrase.decode().split(" ")
            if len(words) == 3:
                for part in (" ".join(words[:2]), " ".join(words[1:])):
                    around[part] = max(around[part], -a)
        kept = sorted(x for x in found if 100 * around[x[2].decode()] < inside * -x[1])[:first]
        out += [(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(kept)]
    return sorted(out)


def _corpus(rng, n=120):
    common = ["the", "of", "a", "New", "york", "é", "漢", "b-1", "\x01", " x"]
    rows = []
    for k in range(n):
        words = [rng.choice(common if rng.random() < 0.7 else [f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 120))]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for w in words), rng.choice(["en", "en", "fr", None])))
    return rows + [(None, "en"), ("", "de"), (" . ", "en"), ("the the the the " * 50, "en"), ("one two three", "xx"), *[rows[3]] * 12]


@pytest.mark.parametrize("budget, slab", [(16, 40), (400, 200), (collocations.BUDGET, collocations._SLAB)])
def test_collocations_match_brute_force(spark, monkeypatch, budget, slab):
    monkeypatch.setattr(collocations.token_runs, "__defaults__", (slab,))
    rows = _corpus(random.Random(budget))
    docs = spark.createDataFrame([(t, g, 1.0, "p", 5) for t, g in rows], "text string, lang string, score double, phrase string, n int").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, budget=budget).collect()))
    assert got == _phrases(rows)
    assert sorted(map(tuple, collocations.collocations(docs, budget=budget, least=3, inside=80, first=7).collect())) == _phrases(rows, 3, 80, 7)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_prefixes_are_extended_until_groups_fit(spark):
    docs = spark.createDataFrame([("a b c " * 300 + "a d " * 40, "en"), ("e f " * 30, "en")], "text string, lang string")
    part, totals = collocations.partition(docs.select("lang", F.col("text").cast("binary")), 200)
    assert [len(x) for x in part.extended] == [3, 3] and totals.collect()[0]["n"] == 1040  # a, b, c and a b, b c, c a
    assert collocations.packed(np.array([90, 90, 30, 5, 300, 1]), 200).tolist() == [0, 0, 1, 1, 2, 3]
    hashes = collocations.prefix_hashes(collocations.word_hashes("en", np.array([b"", b"\xff", b"a", b"b", b"x"], object)), np.array([[2, 3, 4], [2, 3, 2], [4, 2, 3], [4, 2, 0]]))
    assert (hashes[0, :2] == hashes[1, :2]).all() and hashes[2, 1] == hashes[3, 1] and hashes[2, 2] != hashes[3, 2]


def test_counted_prefixes_are_where_suffixes_go():
    """Hashes counted from bytes equal those of the numbered words, by which suffixes are sent to groups."""
    import pyarrow as pa

    text = "a b, c d a b\nx a b c! \t b".encode()
    data = np.frombuffer(next(iter(collocations._prepared(pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"]))))[1], np.uint8)
    plain, piece = collocations.hashed_words(data)
    numbers = collocations.Numbering()
    ids = np.array([numbers[w] for w in data.tobytes().replace(b"\xff", b" \xff ").split()])
    own = collocations.word_hashes("en", numbers.words)
    assert (collocations._seeded(plain, "en") == own[ids[ids > 1]]).all() and piece.tolist() == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3]
    assert len(collocations.hashed_words(data[:0])[0]) == 0


def test_numbering_begins_anew_between_slabs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "_WORDS", 6)
    monkeypatch.setattr(collocations.token_runs, "__defaults__", (10,))
    words = [f"w{k % 23}" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words).encode()])], ["lang", "text"])
    got = collections.Counter()
    for lang, names, keys, n in collocations.gathered(iter([batch])):
        for line, m in zip(collocations.paths_of(keys), n, strict=True):
            got[tuple(names[k].decode() for k in line)] += int(m)
    ends = [*words, "", ""]
    assert got == collections.Counter(zip(ends, ends[1:], ends[2:])) - collections.Counter([("", "", "")])


def test_a_task_deals_its_suffixes_in_few_bytes_each(monkeypatch):
    class Shared:
        value = collocations.Partition((), np.zeros(1 << 10, np.int32))

    size = 1 << 20
    keys = np.sort(np.random.default_rng(3).integers(2, 1000, size) << 42 | np.arange(size) % 1000 + 2 << 21)
    words = np.array([b"", b"\xff", *[b"w%d" % k for k in range(1000)]], object)
    monkeypatch.setattr(collocations, "gathered", lambda batches: [("en", words, keys, np.ones(size, np.int64))])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    total = sum(len(b["n"][0].as_py()) // 8 for b in collocations._blocks(Shared)(iter(())))
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert total == size and most < 64 * size


def test_a_group_reads_its_tree_in_few_bytes_a_suffix():
    class Shared:
        value = collocations.Partition((), np.zeros(1, np.int32))

    size, rng = 1 << 19, np.random.default_rng(4)
    words = b"\xff".join([b"", b"\xff"[:0], *[b"w%d" % k for k in range(998)]])
    path = np.stack([rng.integers(2, 1000, size), np.arange(size) % 998 + 2, rng.integers(2, 1000, size)], 1).astype(np.int32)
    row = ["en", 0, words, path.tobytes(), np.ones(size, np.int64).tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, collocations._BLOCK_TYPES, strict=True)], ["lang", "grp", "words", "path", "n"])
    first = collections.Counter(path[:, 0].tolist())
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    found = [b.to_pydict() for b in collocations._trees(Shared, 10)(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    ones = {p: n for b in found for p, size, n in zip(b["phrase"], b["size"], b["n"], strict=True) if size == 1}
    assert ones == {f"w{k - 2}": n for k, n in first.items() if n >= 10} and most < 72 * size


def test_queries_have_the_contracts_columns(spark, tmp_path, nasty):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == nasty.count()
    assert queries.op13_collocations(spark, str(tmp_path)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())["added_tokens"][0]["content"] in token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")).added
