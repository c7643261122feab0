"""What the operators share: tables, the shared scratch folder, Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove, scratch_path, shared_dir
from ..scratch import stage as materialize

#: Rows of a table of small rows that may be broadcast; copies of each row of a larger one that a hot key is dealt over.
MOST_BROADCAST, SALTS = 200_000, 32
#: Rows of one key from which on it is hot: a table has fewer than its rows / HOT of them.
HOT = 10_000

__all__ = ["forget", "join_hot", "join_small", "materialize", "modest_batches", "scratch_path", "shared_dir", "slices", "table", "text_buffer", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Drop a table of materialize() that nothing reads any more; folders that are not of its making stay."""
    plain = lambda uri: re.sub(r"^\w+:/*", "/", uri).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(folder).startswith(plain(shared_dir(spark)) + "/") and re.search(r"-[0-9a-f]{12}$", folder):
            remove(spark, folder)


def join_small(rows: DataFrame, small: DataFrame, key: str, spread: Column, rows_of_small: int, how: str = "inner") -> DataFrame:
    """`rows` with the one row of `small` of equal key (null equals null); `small` has the key as `__key` and no other name of `rows`.

    A small table of a checked size is broadcast; a larger one is copied SALTS times and the rows dealt by `spread`,
    so that a hot key meets in many tasks.
    """
    same = rows[key].eqNullSafe(small["__key"])
    if rows_of_small <= MOST_BROADCAST:
        return rows.join(F.broadcast(small), same, how).drop("__key")
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copied = small.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copied, dealt[key].eqNullSafe(copied["__key"]) & (dealt["__salt"] == copied["__copy"]), how).drop("__key", "__salt", "__copy")


def join_hot(rows: DataFrame, other: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` left-joined with `other`, which has one row per key and how many `rows` have it (`size`).

    Hot keys are joined by broadcast, the rest by the key, and rows without a key are not shuffled.
    """
    hot, cold = other.where(F.col(size) > HOT), other.where(F.col(size) <= HOT)
    with_hot = rows.join(F.broadcast(hot), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    none = rows.where(F.col(key).isNull())
    for c in other.columns:
        if c != key:
            none = none.withColumn(c, F.lit(None).cast(other.schema[c].dataType))
    return with_hot.unionByName(rest).unionByName(none)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets of length n+1) of a string column without making Python strings; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (a longer single row stands alone)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session: texts are long, and a batch is held on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, giving freed memory back to the system at the end of each task: workers live on, and their sizes add up."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return run
