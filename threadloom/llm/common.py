"""What the operators share: session set-up, text in flat buffers, hashing.

Texts reach Python as Arrow columns.  The helpers here look at a run of rows as
one byte buffer with row offsets, so that words, hashes and boundaries of a
whole run are found by a few array operations instead of a loop over words.
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
U64 = np.uint64

#: Rows of a key that holds this share of all rows or more are joined by broadcast; there can be HOT of them at most.
HOT = 1000
#: Bytes of a batch that goes to a Python worker, unless the session says otherwise.
BATCH = 8 << 20
_DEFAULT_BATCH = 64 << 20
#: Whether an action's shuffles go when it ends; what later actions need is in checkpoints by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that helpers look at together, and entries of the tables that hashing keeps.
RUN = 1 << 18
TABLE = 1 << 20
_KEPT: list[Callable[[], None]] = []


def kept_by_workers(clear: Callable[[], None]) -> None:
    """Name a function that empties what a module keeps in a worker between batches."""
    _KEPT.append(clear)


def release() -> None:
    """Give a worker's memory back: what modules keep, Arrow's free blocks and the allocator's."""
    for clear in _KEPT:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """`run` over batches, and release() when its input ends: workers live longer than tasks, and must not grow from one to the next."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def prepare(spark: SparkSession) -> str:
    """Let Python workers import this package, send them smaller batches than by default, drop an action's shuffles when it ends, and name a checkpoint folder.

    What the session sets itself stays.  Without the clean-up, shuffles of all
    steps stay on the executors' disks until the driver collects garbage.
    The folder of spark.checkpoint.dir is taken where the session has one; where
    it is unset a temporary one is made, which is possible on a local master only.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size).lower() in (str(_DEFAULT_BATCH), f"{_DEFAULT_BATCH}b", "64mb", "64m"):
        spark.conf.set(size, str(BATCH))
    if CLEANUP not in spark.conf.getAll:
        spark.conf.set(CLEANUP, "true")
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="threadloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """settle() with the rows dealt by `key` and sorted by it; groupings by `key` find them so and shuffle no more.

    Adaptive execution is off for this one plan, as its result would not be known to be dealt so.
    """
    spark = df.sparkSession
    prepare(spark)
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join of `rows` to one row per key, safe where one key holds most rows; `how` is left or inner.

    A key with total/HOT rows or more is hot; as sizes add up to `total`, there
    are HOT such keys at most, so that part is broadcast and its rows stay where
    they are.  All other rows meet by a shuffle in which no key is large.
    """
    limit = max(1, -(-total // HOT))
    hot = F.broadcast(groups.filter(F.col(size) >= limit))
    cold = groups.filter(F.col(size) < limit)
    here = rows.join(hot, key, "inner")
    if how == "left":
        rows = rows.join(F.broadcast(groups.filter(F.col(size) >= limit).select(key)), key, "left_anti")
    return here.unionByName(rows.join(cold, key, how))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(column: pa.Array, limit: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of about `limit` bytes; a longer text is a run of its own."""
    buf, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends, and each row's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = mix(np.arange(1, 257, dtype=U64))
_POWERS: list[np.ndarray] = []


kept_by_workers(_POWERS.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; only tables of up to TABLE entries are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = 1 << max(RUN.bit_length(), n.bit_length())
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p, k = np.ones(1, U64), 1
        while len(p) < size:
            p, k = np.concatenate([p, p * U64(pow(base, k, 1 << 64))]), 2 * k
        out.append(p)
    if size <= TABLE:
        _POWERS[:] = out
    return out[0], out[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]: a polynomial by prefix sums, then mixed."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_VALUE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def bytes_hash(text: str | bytes) -> int:
    """span_hashes of one string."""
    b = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `width` consecutive words of each row, and each row's first shingle.

    A row of fewer words, but one at least, has its whole word list as its only shingle.
    """
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(at[-1]) - at[row] + first[row]
    padded = np.concatenate([words, np.zeros(width, U64)])
    left = first[row + 1] - pos
    out = np.zeros(len(pos), U64)
    for k in range(width):
        out = out * U64(0xD6E8FEB86659FD93) + np.where(left > k, padded[pos + k], U64(7 + k))
    return mix(out), at


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{prepare(spark).rstrip('/')}/threadloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
