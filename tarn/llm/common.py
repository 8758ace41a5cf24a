"""Shared pieces: written intermediate tables, byte-level word hashing, mixing functions.

Text work runs inside ``mapInArrow``: a batch's UTF-8 buffer is viewed as one numpy
array, so no Python string is built per word.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the rolling byte hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Arrow batches that text operators ask for hold about so many bytes, unless the session sets a bound itself.
BATCH_BYTES = 8 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has a bound on the bytes of Arrow batches."""
    conf = df.sparkSession.conf
    if _BATCH_BOUND not in conf.getAll:
        conf.set(_BATCH_BOUND, BATCH_BYTES)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share; a local session that names none gets one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker up to 1 Mi entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, U64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * U64(pow(base, filled, 1 << 64))
            filled += step
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and its n + 1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about ``limit`` text bytes each; a longer row is a slice of its own.

    A worker serves many tasks, so it gives freed memory back when the batches end.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = byte_view(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def keep_freed() -> None:
    """Let this worker use freed memory again instead of returning it with every array: up to 64 MB, arrays up to 4 MB."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except AttributeError:
        pass  # no glibc


def give_back() -> None:
    """Return what this worker has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # no glibc



_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of every word, and n + 1 word offsets by row.

    Words are runs of ASCII letters (A-Z lower-cased), digits and any non-ASCII
    character, never across rows.
    """
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        empty = np.empty(0, np.int64)
        return np.empty(0, U64), empty, empty, np.zeros(rows + 1, np.int64)
    inside = _WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    del inside, before, after
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    values = sums[1:]
    values[:] = _LOWER[data]
    values += U64(1)
    values *= powers(BASE, n)
    np.cumsum(values, out=values)
    hashes = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts]
    hashes = mix64(hashes + (ends - starts).astype(U64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the row of each.

    A row of fewer words, but not none, has one shingle of all its words. Repeats stay.
    """
    counts = np.diff(bounds)
    short = counts < width
    spread = np.where(short, 1, counts - width + 1) * (counts > 0)
    owner = np.repeat(np.arange(len(counts)), spread)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(spread) - spread, spread)
    at = bounds[:-1][owner] + place
    out = np.zeros(len(owner), U64)
    for k in range(width):
        here = at + k
        ok = place + k < counts[owner]
        term = np.zeros(len(owner), U64)
        term[ok] = hashes[here[ok]]
        out = mix64(out * U64(BASE) + term + U64(k + 1))
    return out, owner


def with_columns(schema: pa.Schema, batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = [batch.column(i) for i in range(batch.num_columns)] + list(extra.values())
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def counted(shingled: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their rows, and how often each stands there."""
    key = shingled ^ mix64(owner.astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    first = order[at]
    return shingled[first], owner[first], np.diff(np.append(at, len(key)))


def numbered_copies(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every copy of every element, and the element's index: sets of these have multiset overlaps."""
    which = np.repeat(np.arange(len(elements)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(elements[which] + nth.astype(U64) * U64(BASE)), which


def text_digest(column: str = "text"):
    """A 32-byte key of a text; equal texts, and in practice only they, share it."""
    return F.unhex(F.sha2(F.col(column), 256))
