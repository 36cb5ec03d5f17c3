"""Leaks of items of every length, verbatim and paraphrased, against common subsequences computed the plain way."""

import numpy as np
import pytest
import xxhash

from labelweave.llm import decontam


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def _texts(rng, vocabulary):
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return lambda n: rng.choice(vocabulary, n, p=weights / weights.sum()).tolist()


def test_items_of_every_length_are_found_and_no_other(spark):
    rng = np.random.default_rng(11)
    draw = _texts(rng, [f"v{k}" for k in range(20000)])
    lengths = [3, 4, 5, 6, 7, 8, 9, 12, 16, 24, 33, 47, 48, 49, 64, 65, 90, 110, 130, 160, 200, 300, 500, 1000, 2000] * 2
    items = [draw(n) for n in lengths]
    docs = [draw(int(rng.integers(0, 300))) + item + draw(int(rng.integers(0, 300))) for item in items] + [draw(600) for _ in range(50)]
    frame = lambda rows, names: spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], names)
    rows = decontam.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(k, k) for k in range(len(items))} <= got
    for doc, item in got - {(k, k) for k in range(len(items))}:  # chance: only what the plain way finds too
        words, text = items[item], docs[doc]
        assert len(words) < 10 and _lcs(words, text) >= decontam.LOOSE * len(words)
    assert all(0 < r["cosine"] <= 1 and r["share"] <= 1 for r in rows)
    place = {r["doc_id"]: r["word"] for r in rows if r["doc_id"] == r["item_id"]}
    for k, item in enumerate(items):
        start = next(j for j in range(len(docs[k])) if docs[k][j : j + len(item)] == item)
        assert place[k] <= start < place[k] + 2 * len(item) + 64


@pytest.mark.parametrize("kept", [0.9, 0.75, 0.6])
def test_paraphrases_are_found(spark, kept):
    rng = np.random.default_rng(7)
    draw = lambda n: rng.choice([f"v{k}" for k in range(3000)], n).tolist()
    items, docs = [], []
    for number, n in enumerate([12, 20, 30, 45, 60, 90, 140, 250] * 10):
        item = draw(n)
        for k, place in enumerate(rng.choice(n, 3, replace=False)):
            item[place] = f"answer{number}x{k}"
        body = []
        for w in item:
            if w.startswith("answer") or rng.random() < kept:
                body.append(w)
            body += [f"x{rng.integers(10**6)}"] * int(rng.random() < 0.3)
        items.append(item)
        docs.append(draw(200) + body + draw(200))
    frame = lambda rows, names: spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], names)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    want = {(k, k) for k in range(len(items)) if _lcs(items[k], docs[k]) >= (0.55 if kept < 0.8 else 0.8) * len(items[k])}
    assert len(got & want) >= 0.9 * len(want) > 0 and not {x for x in got - want if x[0] != x[1]}


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"é{k}" for k in rng.integers(0, 5000, 6000)]
    text = " ".join(words).encode()
    data, offsets = np.frombuffer(text + b"tail", np.uint8), np.array([0, len(text), len(text) + 4])
    whole = decontam.words_of(data, offsets)
    monkeypatch.setattr(decontam, "_CHUNK", 700)
    assert all((a == b).all() for a, b in zip(whole, decontam.words_of(data, offsets), strict=True)) and len(whole[0]) == 6001


def test_one_block_of_items_is_live_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(f"v{x}" for x in rng.choice(4000, n))
    items = [(k, draw(20)) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, draw(60) + " " + items[k][1] + " " + draw(60) if k % 2 else draw(120)) for k in range(40)], "doc_id long, text string")
    live, most = set(), []

    class Watched:
        def __init__(self, broadcast):
            self.inner, self.value = broadcast, broadcast.value
            live.add(id(self))
            most.append(len(live))

        def destroy(self):
            live.discard(id(self))
            self.inner.destroy()

    real, own = type(spark.sparkContext).broadcast, decontam._matches
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: Watched(real(self, value)) if isinstance(value, decontam.Searcher) else real(self, value))
    monkeypatch.setattr(decontam, "_matches", lambda spark, shared, text: own(spark, shared.inner, text))
    for block in (100, 5):
        most.clear()
        found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, block=block).collect()}
        assert found == {(k, k) for k in range(1, 40, 2)} and not live and max(most) == 1 and len(most) == -(-40 // block)
        kept = {r["doc_id"] for r in decontam.clean(docs, bench, block=block).collect()}
        assert kept == set(range(0, 40, 2)) and max(most) == 1
        live.clear()


def test_the_basis_is_fitted_on_all_passages(spark):
    rng = np.random.default_rng(6)
    common = [" ".join(f"c{k}" for k in rng.integers(0, 400, 10)) for _ in range(40)]
    signed = lambda text: np.array([xxhash.xxh64_intdigest(decontam.text_words(text.encode()).tobytes(), 42)], np.uint64).view(np.int64)[0]
    # Of the passages below that are not `common`, this one has the largest hash: what is cut off by hashes is cut off here.
    rare = max((" ".join(f"r{k}x{j}" for j in range(10)) for k in range(300)), key=signed)
    rows = [(k, common[k % 40]) for k in range(8600)] + [(9000, rare)]
    idf = np.ones(decontam.BUCKETS, np.float32)
    basis = decontam.latent_basis(spark.createDataFrame(rows, "item_id long, text string"), idf)
    used = np.unique(decontam.bucket_of(decontam.text_words(rare.encode())))
    assert signed(rare) > max(signed(x) for x in common) and np.linalg.norm(basis[used].sum(0)) / np.sqrt(len(used)) > 0.95
