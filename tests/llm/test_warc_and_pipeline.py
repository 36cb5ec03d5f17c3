import gzip
import hashlib

import numpy as np
import pytest

import corpus_pipeline
from labelweave.llm import components, warc


def _pages(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    rows = [(k, f"http://a/{k}", f"<p>page {k} é</p>" * (k % 40)) for k in range(150)]
    rows += [(200, None, None), (201, "http://x y", ""), (202, "u", fake * 3), (203, "u", "z" * 200 + fake), (204, "u", "z" * 200 + fake), (300, "u", "q" * 99), (301, "u", "q" * 99)]
    rows += [(5, "http://again", "<p>page 5 é</p>" * 5), (None, "n", "z" * 200 + fake), (None, "n", "lone" * 50)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_give_every_page_back(spark):
    pages, rows = _pages(spark)
    got = warc.round_trip(pages.repartition(3), archive=2000).collect()
    smallest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            smallest[body] = min(i, smallest.get(body, i))
    many = [body for body in smallest if sum((h or "").encode() == body for _, _, h in rows) > 1]
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = smallest.get(body) if body in many else None
        refers = first if first is not None and first != i else None
        want.append((str(i), len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", str(refers)))
    assert sorted(want) == sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_long_urls_many_magics_and_clashing_columns(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000000\r\n\r\n"
    rows = [(1, "http://long/" + "u" * 1_000_000, "x" * 200, "a", 1), (2, "m", "WARC/1.1\r\n" * 200_000, "b", 2), (3, "n", head * 20_000, "c", 3), (4, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _digest string, start int")
    got = {r["page_id"]: r for r in warc.round_trip(pages, archive=100_000).collect()}
    for i, url, html, _, _ in rows:
        body = (html or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha256(body).hexdigest() and got[i]["payload_bytes"] == len(body) and got[i]["url"] == url
    many = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('p', id), 200) AS html")
    warc.write(many, f"file://{tmp_path}/many", archive=20_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "many").glob("*.gz")]
    assert max(sizes) <= 20_000 and len(sizes) > 10 and warc.read(spark, f"file://{tmp_path}/many").count() == 400


def test_damage_is_an_error(spark, tmp_path):
    pages, _ = _pages(spark)
    warc.write(pages.coalesce(1), f"file://{tmp_path}/w")
    file = next((tmp_path / "w").glob("*.gz"))
    body = gzip.decompress(file.read_bytes())
    with pytest.raises(Exception, match="end of the file"):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "a.gz").write_bytes(gzip.compress(body.replace(b"page 7 ", b"page seven ", 1)))
        warc.read(spark, f"file://{tmp_path}/bad").count()


def test_pointer_jumping():
    starts = np.array([0, 5, 10, 12, 20, 30])
    nexts = np.array([10, 12, 20, 30, 30, -1])
    assert warc.reachable(starts, nexts).tolist() == [True, False, True, False, True, True]


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (101, 100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_columns_and_take_effect(spark, nasty, empty, tmp_path):
    nasty.limit(0)
    item = " ".join(f"secretitem{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = [(500, f"the water runs over stone {item} and light", "en", "a", 1, 0.5, "s", "r", "f", "k"), (501, "the water runs password=abcdef0123456789abcd over stone and the light", "en", "zz", 1, 0.5, "s", "r", "f", "k")]
    docs = nasty.unionByName(spark.createDataFrame(extra, nasty.schema))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(nasty.columns)] == nasty.columns and (len(out.columns) == len(nasty.columns) or number == 4)
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/stage{number}")
        docs = spark.read.parquet(f"{tmp_path}/stage{number}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert number != 0 or not {93, 94, 95, 96} & set(ids)
        assert number != 1 or (ids.count(90) == 1 and 91 not in ids)
        assert number != 2 or 500 not in ids
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert "abcdef0123456789" not in kept[501]["text"] and kept[501]["n_chars"] == len(kept[501]["text"]) and kept[501]["mix_taken"] > 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
