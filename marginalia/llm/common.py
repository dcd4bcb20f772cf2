"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a worker handles at once; longer single texts are handled alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Only a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, buckets: int, column: str) -> DataFrame:
    """``stored`` in so many buckets by hash of ``column``: a join on it with as many partitions shuffles the other side alone.

    Cells are meant to be compressed already.  The table's name is given up at once; its files stay with the other stored ones.
    """
    spark, name = df.sparkSession, f"marginalia-{label}-{uuid.uuid4().hex}"
    table = f"spark_catalog.default.{name.replace('-', '_')}"
    df.write.format("parquet").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a side that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` (narrow ones) allow it."""
    return F.broadcast(df) if rows <= most else df


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Return freed memory to the machine: workers live on between stages, and what they keep adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # of the C library of Linux only
        trim(0)


def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the worker's last task and this one freed is given back before and after."""
    give_back()
    try:
        yield from batches
    finally:
        give_back()


def chunks(batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about ``size`` bytes of ``column``."""
    for batch in tidy(batches):
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        at = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words between spaces and bytes 9 to 13, A to Z in lower case.  ``bytes.split`` cuts at exactly those bytes."""
    return text.lower().split()


def segment_starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def partitions_for(rows: int, per_task: int, least: int = 1) -> int:
    return max(least, -(-rows // per_task))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words in lists for about ``size`` bytes each, so that a huge text is never one huge list."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield words_of(text[at : found.start()])
        at = found.end()
    yield words_of(text[at:] if at else text)


class Memo(dict):
    """A cache of ``make(key)`` that starts anew after ``most`` entries."""

    def __init__(self, make: Callable, most: int = 1_000_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out
