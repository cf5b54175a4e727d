"""Helpers shared by the corpus operators: the shared folder, written tables, and Arrow text access."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of the driver gets a local folder; any other is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lexweft-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lexweft-{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to a Python worker at a time while a table is written: texts are long, and both sides hold a batch.
ROWS_PER_BATCH = 2000
_lock = threading.Lock()
_writers: dict[int, tuple[int, str]] = {}


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Hold the session's batches at ``ROWS_PER_BATCH`` rows; the first of several threads sets it, the last one resets it."""
    with _lock:
        n, before = _writers.get(id(spark), (0, spark.conf.get(_ARROW_ROWS)))
        _writers[id(spark)] = n + 1, before
        if not n:
            spark.conf.set(_ARROW_ROWS, str(min(int(before), ROWS_PER_BATCH) if int(before) > 0 else ROWS_PER_BATCH))
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(id(spark))
            if n > 1:
                _writers[id(spark)] = n - 1, before
            else:
                spark.conf.set(_ARROW_ROWS, before)


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table, in the shared folder unless ``path`` says where, and read it back.

    The table outlives lost executors, and every later plan that uses it sees the same rows.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with _small_batches(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexweft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later plan reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lexweft_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a narrow table (under about 64 bytes a row) is sent to all executors.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has ``BROADCAST_ROWS`` rows at most; else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's contents; rows with equal contents share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols])


def labelled_texts(docs: DataFrame, known: DataFrame, most_rows: int, most_bytes: int) -> pa.Table:
    """(doc_id, y, text) by doc_id: a bounded sample of ``docs`` (doc_id, text) with the labels of ``known`` (doc_id, y).

    One text a doc_id, the first of several. The first ``most_rows`` by a hash of doc_id are taken, and of them as many
    as have ``most_bytes`` together, a text that does not fit any more being passed over.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = known.select("doc_id", F.col("y").alias("__lw_y")).orderBy(*order).limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id", "__lw_y").agg(F.min("text").alias("text"))  # most_rows rows
    rows = written(rows, "sample")
    taken, left = [], most_bytes
    for r in rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(*order).collect():  # most_rows rows
        if r["n"] <= left:
            taken.append(r["doc_id"])
            left -= r["n"]
    chosen = rows.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", F.col("__lw_y").alias("y"), "text").toArrow().sort_by("doc_id")


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offset of each row (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("")
    n = len(arr)
    wide = pa.types.is_large_string(arr.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def row_chunks(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``most`` bytes at most, or one row each: bounds what a step keeps in memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, b, U64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes between words for shingles: space and the control characters 9 to 13.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = lower_ascii()


class Words:
    """The words of some rows, in order: row numbers, starts and ends in bytes, and hashes on demand.

    A word is a maximal run of bytes outside ``breaks`` in one row; ``fold`` maps bytes before hashing.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACES, fold: np.ndarray = LOWER):
        n = len(data)
        inside = ~breaks[data]
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        first[n] = True
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | first[1:-1]
            end[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.rows = np.searchsorted(off, self.starts, "right") - 1
        up, self._down = _powers(n + 1)
        self._total = np.zeros(n + 1, U64)
        np.cumsum((fold[data].astype(U64) + U64(1)) * up[:n], out=self._total[1:])

    def hashes(self, head: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``head`` bytes."""
        ends = self.ends if head is None else np.minimum(self.ends, self.starts + head)
        h = (self._total[ends] - self._total[self.starts]) * self._down[self.starts]
        return mix64(h + (ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words_of(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACES, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, row numbers, starts and ends (in bytes) of the words of some rows, in order."""
    w = Words(data, off, breaks, fold)
    return w.hashes(), w.rows, w.starts, w.ends
