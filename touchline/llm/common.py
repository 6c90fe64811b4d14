"""Shared helpers: tables written to the shared folder, checked broadcasts, byte-level text arithmetic."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A table of at most this many narrow rows (ids, counts) may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000
#: Bytes of a row group of a staged table; a writing task holds about one in memory.
ROW_GROUP = 16 << 20
#: Rows of an Arrow batch, which the JVM and the Python worker both hold.
RECORDS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; from now on this session's Python workers get at most RECORDS rows at a time."""
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= RECORDS:
        spark.conf.set(_BATCH, str(RECORDS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs in one process (tests), a new temporary folder becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline-{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most so many rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its row count allows it, else df, which then joins by shuffling."""
    return F.broadcast(df) if fits(df, rows) else df


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def remainder(id_col, n: int):
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- byte-level text arithmetic

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them; a worker keeps those of its longest block."""
    if len(_powers[0]) < n:
        size = max(n + n // 4, 1 << 17)
        for k, x in enumerate((_BASE, _INVERSE)):
            step = np.full(size, x, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@lru_cache(maxsize=1)
def _trim():
    """malloc_trim of the C library, or nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return memory that Arrow and numpy have freed to the system; a reused Python worker would hold it between tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def blocks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one longer row. Unused memory goes back to the system after the last."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j
    give_back()


def fold_ascii(b: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return b + (((b >= 65) & (b <= 90)).view(np.uint8) << 5)


class Words:
    """Words (runs of bytes that are not white space) of a block of rows."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        self.b, self.offsets = b, offsets
        n = len(b)
        inside = np.zeros(n + 2, bool)
        np.logical_not(SPACE[b], out=inside[1:-1])
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] |= inside[1:-1][cut]
        last[cut - 1] |= inside[1:-1][cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        #: Words before each row, and in all.
        self.before = np.searchsorted(self.start, offsets)

    def sums(self) -> np.ndarray:
        out = np.zeros(len(self.b) + 1, np.uint64)
        np.cumsum(_BYTE[self.b] * powers(len(self.b) + 1)[0][: len(self.b)], out=out[1:])
        return out

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return spans_hash(self.sums(), self.start, self.end)


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from prefix sums of scrambled bytes times powers of the base."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, in order, for each place where n remain."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _ODD[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * _ODD[k]
    return mix(out)
