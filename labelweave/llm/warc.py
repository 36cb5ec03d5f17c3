r"""WARC archives: written by Spark's text sink, read back by verified record boundaries.

A record is its header, a blank line, the payload and two line ends. Tasks put records together until
the next would exceed ARCHIVE bytes; each such row is a file of its own (a larger record is one file),
and the sink's line separator ends its last record. Files are gzip-compressed as a whole, since the
sink compresses files, not rows. Of records with equal payloads of at least REVISIT bytes, that with
the smallest id is a response and the others revisit it, without a payload of their own.

Reading: every place that looks like a record start is a candidate, also inside payloads. Tasks emit
each candidate with the place where its successor would start; pointer jumping from the start of
each file marks what is reachable, and the rest is dropped. Only reachable records are hashed, in a
second pass over the files. A group is one file's candidates. A header has no record start inside, so
headers never overlap and a payload full of record starts costs no more than its length. A chain that
doesn't end at the end of its file, or a payload that isn't what its header says, is an error, so that a
damaged archive never passes for a shorter one.

A null payload is an empty one. A null id sorts last and is never referred to; rows that repeat the
smallest id of their payload are responses too. Null or odd URLs, of any length, are left out or have
their control characters replaced. An empty table gives no record. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import checkpoint, remove, shared_folder

#: Least payload that others revisit; bytes of a file before compression, unless one record is larger.
REVISIT, ARCHIVE = 100, 32 << 20
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CANDIDATE = "file string, start long, next long, body long, stop long, page_id long, url string, record_type string, refers_to long, payload_bytes long, declared string"
_RECORD = "file string, start long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_KINDS = {"string": pa.string(), "long": pa.int64()}


def with_types(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """pages with `_digest`, `_bytes` and `_first`, the id that the row revisits or null.

    The ids of equal payloads are aggregated without their payloads; a very frequent payload is one
    row of that table, and Spark splits the join's other side.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    named = pages.withColumns({"_digest": F.sha2(body, 256), "_bytes": F.octet_length(body).cast("long")})
    firsts = (
        named.where(F.col("_bytes") >= REVISIT)
        .groupBy(F.col("_digest").alias("_same"))
        .agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull())
        .drop("_n")
    )
    joined = named.join(firsts, named["_digest"] == firsts["_same"], "left").drop("_same")
    return joined.withColumn("_first", F.when(~F.col(key).eqNullSafe(F.col("_first")), F.col("_first")))


def record(payload: str = "html", key: str = "page_id", url: str = "url", date: str = "1970-01-01T00:00:00Z") -> Column:
    """A row of with_types() as a WARC record without the line ends behind it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisits = F.col("_first").isNotNull()
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(key)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        F.when(revisits, F.concat(line("WARC-Refers-To", urn("_first")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisits, F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisits, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit(""))),
    )


def _archives(most: int):
    """Puts records together, as many as fit in `most` bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held).decode()], pa.string())], ["value"])
        for batch in batches:
            for value in batch.column(0):
                body = value.as_buffer().to_pybytes()
                if held and size + len(body) + len(END) > most:
                    yield row()
                    held, size = [], 0
                held.append(body)
                size += len(body) + len(END)
        if held:
            yield row()

    return pack


def write(pages: DataFrame, path: str, payload: str = "html", key: str = "page_id", url: str = "url", archive: int = ARCHIVE) -> None:
    """Archives of all pages under path."""
    rows = with_types(pages.select(key, url, payload), payload, key).select(record(payload, key, url).alias("value"))
    packed = rows.mapInArrow(_archives(archive), "value string")
    packed.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _number(header: dict[bytes, bytes], name: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>|(\d+)", header.get(name, b""))
    return int(found[1] or found[2]) if found else None


def _places(body: bytes, mark: bytes) -> list[int]:
    found, at = [], body.find(mark)
    while at >= 0:
        found.append(at)
        at = body.find(mark, at + 1)
    return found


def candidates(body: bytes, file: str) -> Iterator[tuple]:
    """A row of _CANDIDATE for each place of body that could start a record, and one for its end."""
    starts, ends = _places(body, MAGIC), _places(body, END)
    for at, following in zip(starts, [*starts[1:], len(body)], strict=False):
        # The line end of the magic itself may begin the blank line: a header without fields.
        k = bisect.bisect_left(ends, at + len(MAGIC) - 2)
        if k == len(ends) or ends[k] >= following:
            continue
        header = dict(x.split(b": ", 1) for x in body[at + len(MAGIC) : ends[k]].split(b"\r\n") if b": " in x)
        length = header.get(b"Content-Length", b"")
        if not length.isdigit() or len(length) > 18:
            continue
        start = ends[k] + len(END)
        stop = start + int(length)
        url, revisit = header.get(b"WARC-Target-URI"), header.get(b"WARC-Type") == b"revisit"
        yield (
            file, at, stop + len(END) if body[stop : stop + len(END)] == END else -1, start, stop, _number(header, b"WARC-Record-ID"),
            url.decode("utf-8", "replace") if url is not None else None, "revisit" if revisit else "response", _number(header, b"WARC-Refers-To"),
            _number(header, b"X-Payload-Length") if revisit else stop - start, header.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha256:").decode("ascii", "replace"),
        )
    yield (file, len(body), -1, len(body), len(body), None, None, "end", None, None, None)


def _inflated(raw: bytes) -> bytes:
    """A file's records: all its gzip members, one after another, or the file itself."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    parts = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts += [member.decompress(raw), member.flush()]
        raw = member.unused_data
    return b"".join(parts)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from _table(list(candidates(_inflated(content.as_py()), file)), _CANDIDATE).to_batches(65536)


def reachable(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Mask of the starts (in order) that the chain from place 0 passes, by pointer jumping."""
    n = len(starts)
    jump = np.searchsorted(starts, nexts)
    jump = np.where((jump < n) & (starts[np.minimum(jump, n - 1)] == nexts), jump, n)
    jump = np.r_[jump, n]
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and starts[0] == 0
    for _ in range(max(1, n).bit_length() + 1):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _chained(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("start", ignore_index=True)
    seen = reachable(part["start"].to_numpy(), part["next"].to_numpy())
    if not seen[-1]:
        raise ValueError(f"{part['file'].iloc[0]}: the records don't lead to the end of the file")
    return part[seen & (part["record_type"] != "end")]


def _hashed(key: tuple, records: pa.Table, files: pa.Table) -> pa.Table:
    """Records with the digests of their payloads; a revisit has that of its header."""
    if not records.num_rows:
        return _table([], _RECORD)
    body, rows = memoryview(_inflated(files["content"][0].as_py())), []
    for r in records.to_pylist():
        digest = r["declared"] if r["record_type"] == "revisit" else hashlib.sha256(body[r["body"] : r["stop"]]).hexdigest()
        if digest != r["declared"]:
            raise ValueError(f"{r['file']}: the payload at {r['body']} isn't what its header says")
        rows.append((*(r[x.split()[0]] for x in _RECORD.split(", ")[:-1]), digest))
    return _table(rows, _RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: file, start, page_id, url, record_type, refers_to, payload_bytes, payload_digest."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    chained = files.mapInArrow(_scan, _CANDIDATE).groupBy("file").applyInPandas(_chained, _CANDIDATE)
    return chained.groupBy("file").cogroup(files.groupBy("file")).applyInArrow(_hashed, _RECORD)


def round_trip(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url", archive: int = ARCHIVE) -> DataFrame:
    """Writes archives of all pages to the shared folder, reads them back and removes them, also where reading fails."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    try:
        write(pages, path, payload, key, url, archive)
        return checkpoint(read(spark, path))
    finally:
        remove(spark, path)
