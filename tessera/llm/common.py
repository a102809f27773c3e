"""What the corpus operators share: reading, work tables, hashing of words in Arrow batches.

Texts are handled as the UTF-8 bytes of whole Arrow columns.  A null text counts as empty
everywhere.  Hashes are 64 bits wide; two different words or runs of words collide with a
probability of about n^2 / 2^65.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of ids (16 bytes each, with overhead under 200 MB) sent to every executor.
#: Beyond it the same join runs by shuffling both sides.
BROADCAST_IDS = 1_000_000

#: Bytes of text that one vectorised step works on; a longer document makes a step of its own.
STEP_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-work")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def stash_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stash, bucketed by key: a join or cogroup by it needs no shuffle of this side.  The table is known to no catalog afterwards."""
    spark = df.sparkSession
    path, title = work_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark allows no more
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(title)
    out = spark.table(title)
    spark.sql(f"DROP TABLE {title}")  # an external one: its files stay
    return out


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str, count: int | None = None) -> DataFrame:
    """left_semi or left_anti join of df with the table of ids, broadcast only while its counted size allows it."""
    n = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, how)


# ---------------------------------------------------------------- bytes of Arrow columns


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one uint8 array, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary()).fill_null(b"")
    else:
        col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + 65536)
        for k, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * base^-s being a polynomial hash of raw[s:e], modulo 2^64."""
    up, _ = _pow(len(raw) + 1)
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _pow(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and how many words come before each row (n + 1 numbers)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a row begins here
    cut[off] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last[:-1] &= ~ink[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span of bytes: its blocks of eight bytes are scrambled, each by its place, before they are summed."""
    size = end - start
    eight = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(16, np.uint8)).tobytes(), strides=(1,))  # the eight bytes from each place on
    low = lambda left: _U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * (_U(8) - np.clip(left, 1, 8).astype(_U)))
    h = mix(eight[start] & low(size)) * (size > 0)
    if len(long := np.flatnonzero(size > 8)):
        count = (size[long] - 1) // 8  # blocks after the first
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        at = np.repeat(start[long], count) + 8 * k
        parts = mix((eight[at] & low(np.repeat(end[long], count) - at)) ^ mix(k.astype(_U)))
        h[long] += np.add.reduceat(parts, np.cumsum(count) - count)
    return mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the n + 1 word offsets of the rows."""
    start, end, woff = word_spans(raw, off)
    return span_hashes(raw, start, end), woff


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; runs across rows are the caller's to leave out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    h = words[:m].copy()
    for j in range(1, n):
        h = mix(h * _U(0x9FB21C651E98DF25) + words[j : j + m])
    return h
