"""Shared helpers of the training-data operators.

Texts travel between the JVM and Python as Arrow batches. The helpers here cut a
batch into chunks of bounded bytes and work on the UTF-8 bytes with numpy, so a
Python worker never holds more than a few arrays of a chunk, whatever the size
of a table. One very long text is a chunk of its own.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000

#: Bytes A-Z as a-z, all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; only where it is unset (tests), a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "kitmeter-checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of rows that may be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: by its rows and by their bytes, of arrays and all."""
    n, total = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return n <= rows and (total or 0) <= size


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` whole rows with about ``limit`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(sizes)
    start = 0
    while start < n:
        base = at[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(at, base + limit, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and n+1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    mask = member[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Longer words are hashed one by one.
_LONG = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time are mixed in by a bijection, so
    words of one length of up to eight bytes never share a hash, and no family of longer words does by its form."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    length = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9E3779B97F4A7C15))
    h = mix(h ^ (lanes[starts] & _MASKS[np.minimum(length, 8)]))
    live, k = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(live):
        lane = lanes[starts[live] + k] & _MASKS[np.minimum(length[live] - k, 8)]
        h[live] = mix(h[live] * np.uint64(0xD1342543DE82EF95) ^ lane)
        k += 8
        live = live[length[live] > k]
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@contextmanager
def kept_settings(spark: SparkSession) -> Iterator[None]:
    """What is run whole inside leaves the session's Arrow settings as they were. Frames that are run later
    need the lower ones, so the operators themselves can't put them back."""
    before = [spark.conf.get(x) for x in _SETTINGS]
    try:
        yield
    finally:
        for x, value in zip(_SETTINGS, before):
            spark.conf.set(x, value)


def bounded_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows, and no more rows beyond CHUNK_BYTES, in an Arrow batch of this session, which is held
    whole on both sides of a Python worker."""
    for name, most in zip(_SETTINGS, (BATCH_ROWS, CHUNK_BYTES)):
        now = spark.conf.get(name)  # with a unit where it is the default
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


#: What operators keep in a worker between their tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator's tasks keep in this worker; see ``task``."""
    return _KEPT.setdefault(owner, {})


def trim() -> None:
    """Give freed memory back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def begin(owner: str) -> None:
    """Drop what other operators kept in this worker."""
    others = [x for x in _KEPT if x != owner]
    for x in others:
        del _KEPT[x]
    if others:
        trim()


Batches = Iterator[pa.RecordBatch]


def task(run: Callable[[Batches], Batches], owner: str = "") -> Callable[[Batches], Batches]:
    """The function of a mapInArrow step. Workers serve one operator after another and live on beside the
    JVM: a task first drops what other operators kept, and at its end gives freed memory back."""

    def whole(batches: Batches) -> Batches:
        begin(owner)
        yield from run(batches)
        trim()

    return whole


def text_column(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of a table that may carry others of any name."""
    bounded_batches(df.sparkSession)
    return df.select(*[df[f"`{x}`"].alias(x) for x in names])
