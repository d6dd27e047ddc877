"""Shared pieces of the corpus operators: written intermediate tables and word hashing on Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed together; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches bound a Python worker's memory; shuffle files go when the action that made them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    except Exception:  # noqa: BLE001  an older Spark keeps them until its driver collects garbage
        pass
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder. Where that is unset, a local one on a local master (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "cinderpath-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and gives Spark true sizes."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that save() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _pow_table(n: int, base: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15
    up = down = np.ones(1, _U)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            cls.up = _pow_table(n, cls.BASE)
            cls.down = _pow_table(n, pow(cls.BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit moves each output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word: anything but ASCII white space; letters, digits and whatever isn't ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def text_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets of the rows in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j]-h[i], times the inverse power of i, depending on data[i:j] alone."""
    _Powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _Powers.up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _Powers.down[start] + (end - start).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of each lower-cased word, and the number of the first word of each row (one more at the end)."""
    kind = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = kind[:-1]
    start = np.flatnonzero(kind & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = kind[1:]
    end = np.flatnonzero(kind & (~after | first[1:])) + 1
    hashes = span_hash(prefix_hash(_LOWER[data]), start, end)
    return hashes, start, end, np.searchsorted(start, offsets, "left")


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbouring hashes, in order; row ends are the caller's business."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for i in range(k):
        total = total * _U(0x9FB21C651E98DF25) + hashes[i : i + n]
    return mix(total + _U(k))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0..n-1 with links (a, b), the least node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
