"""What the operators of this subpackage share: reading, cutting lineage, byte kernels."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time (a longer text is handled alone).
CHUNK_BYTES = 1 << 20

#: Base of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only in local mode a temporary folder may stand in for it: on a cluster the executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return context.getCheckpointDir()


def release() -> None:
    """Give unused memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on this session's Arrow batches have about `most` bytes, unless it names a size of its own.

    Batches of 10,000 whole texts are tens of MB, and a task holds several in the JVM and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most))


def sweep(spark: SparkSession) -> None:
    """Have the shuffle files of plans deleted that nothing names any more.

    Spark's cleaner learns of them when the driver collects its garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    Files of a table that nothing uses any more are the cleaner's.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that a salted join deals out, at most, and rows of a key that stay together in any case.
HOT_KEYS = 50_000
LEAST_HOT = 64


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, rows: int | None = None, hot_keys: int = HOT_KEYS) -> DataFrame:
    """left joined to right by keys, where some keys may stand in a large part of left's rows.

    A key with over max(LEAST_HOT, rows / hot_keys) rows is cut into salts of that many rows, and right's
    rows of it are repeated once a salt. So at most hot_keys keys are salted, which bounds the list of them
    that is broadcast and the rows that are repeated. left should be cheap to read twice, or counts
    given: (keys, _n) with the rows of each key, and rows, the number of left's rows.
    """
    rows = left.count() if rows is None else rows
    limit = max(LEAST_HOT, -(-rows // hot_keys))
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))
    own = [c for c in left.columns if c not in keys] or keys
    salt = F.coalesce(F.pmod(F.xxhash64(*own), F.col("_salts")), F.lit(0)).cast("int")
    a = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def text_buffers(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string or binary column as (first row, bytes, offsets), about CHUNK_BYTES each.

    Nulls count as empty. Offsets start at 0 and have one more entry than the slice has rows.
    """
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        if array.null_count:
            array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
        _, offsets, data = array.buffers()
        n = len(array)
        if not n:
            continue
        offset = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
        buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offset, offset[first] + CHUNK_BYTES, "right")) - 1
            last = min(max(last, first + 1), n)
            yield first, buffer[offset[first] : offset[last]], offset[first : last + 1] - offset[first]
            first = last


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            self._up = np.full(size, _BASE, np.uint64)
            self._down = np.full(size, _INVERSE, np.uint64)
            self._up[0] = self._down[0] = 1
            np.multiply.accumulate(self._up, out=self._up)
            np.multiply.accumulate(self._down, out=self._down)
        return self._up[:n], self._down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of symbols[t] * base**t for i <= t < j, modulo 2**64."""
    up, _ = POWERS.get(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbols[start:end]; equal contents have equal hashes wherever they stand."""
    _, down = POWERS.get(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the index of each row's first word (one entry more)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    edge = solid[1:] != solid[:-1]
    start_at, end_at = edge & solid[1:], edge & solid[:-1]
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        both = cuts[solid[cuts] & solid[cuts + 1]]  # a word that ends where the next row's first begins
        start_at[both] = end_at[both] = True
    starts, ends = np.flatnonzero(start_at), np.flatnonzero(end_at)
    return starts, ends, np.searchsorted(starts, offsets)
