"""What several text operators share: reading, chunking Arrow batches, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts, `[^\x20\x09-\x0D]+`, as Java and RE2 read it.
WORD = r"[^\x20\x09-\x0D]+"

#: Deletes the bytes that continue a UTF-8 character, so that what is left counts code points.
CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\r\x0b\x0c"
_BLANK = np.isin(np.arange(256), list(BLANKS))

#: ASCII letters and digits and all bytes of other characters stay, A-Z in lower case; the rest becomes a blank.
ALNUM = bytes(
    b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """A string column as bytes, null as empty: Python then needs no decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text (0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets spark.checkpoint.dir as the session's checkpoint folder; only local sessions may go without it and get one of their own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder of the session and cut off from its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a binary Arrow array, without a copy."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a row above that stands alone."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row ranges of spans() with their bytes and offsets from 0; a longer row alone, cut at blanks into pieces of about `most` bytes.

    Every piece comes with the number of its first row. Words are never cut: a piece of a longer row
    ends behind a blank, wherever the next one is.
    """
    for first, last in spans(offsets, most):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= most:
            yield first, data[low:high], offsets[first : last + 1] - low
            continue
        while low < high:
            stop = min(low + most, high)
            while stop < high:
                window = np.flatnonzero(_BLANK[data[stop : stop + 4096]])
                if len(window):
                    stop += int(window[0]) + 1
                    break
                stop += 4096
            stop = min(stop, high)
            yield first, data[low:stop], np.array([0, stop - low])
            low = stop


_ODD = np.uint64(0x9E3779B97F4A7C15)
_UP: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _UP or len(_UP[0]) < n:
        size = 1 << n.bit_length()
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _UP[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (_ODD, inverse)]
    return _UP[0][:n], _UP[1][:n]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 as numbers, what is no UTF-8 replaced, and the offsets in characters; offsets start at 0."""
    raw = data[: int(offsets[-1])]
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), offsets
    before = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    whole = raw.tobytes()
    found = np.frombuffer(whole.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(found) == before[-1]:
        return found, before[offsets]
    rows = [whole[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(rows), np.uint32), np.r_[0, np.cumsum([len(x) // 4 for x in rows])]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder, which driver and executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path that shared_folder() gave, in whatever store it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
