"""Vectorised text helpers that the operators share: Arrow buffers, byte chunks, word hashes, names."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of documents.
BATCH_ROWS = 2500

_PRIME = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_WORD = np.zeros(256, dtype=bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")] = True
_WORD[128:] = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, as a URI: spark.checkpoint.dir, or the one already set on the context.

    Where neither is set, one is made if all runs in this process (tests on one machine); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="glyphmine-")
        context.setCheckpointDir(folder)
    folder = context.getCheckpointDir()
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded to ``BATCH_ROWS`` rows if they are at Spark's default size.

    A batch of documents is held by the JVM and by the Python worker at once, beside the executor's heap.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    offs = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def spans(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes; every row is in exactly one."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def chunks(column: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = buffers(column)[1]
    for lo, hi in spans(offs, most):
        part = column.slice(lo, hi - lo)
        data, own = buffers(pc.utf8_lower(part) if lower else part)
        yield lo, hi, data, own


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and its neighbours need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * CHUNK_BYTES)
        _powers[:] = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix64_int(x: int) -> int:
    """``mix64`` of one Python integer."""
    return int(mix64(np.array([x & _M64], dtype=np.uint64))[0])


def word_hashes(data: np.ndarray, offs: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word occurrence and the row that holds it.

    A word is a longest run of ASCII letters, digits, underscores and non-ASCII bytes. ``beginnings``: the first so many bytes of
    each longer word count as words as well, after the whole ones.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _WORD[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, w[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, w[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    p, inv = _pow(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    row = np.searchsorted(offs, start, side="right") - 1
    starts, ends, rows = [start], [end], [row]
    for n_bytes in beginnings:
        longer = end - start > n_bytes
        starts.append(start[longer])
        ends.append(start[longer] + n_bytes)
        rows.append(row[longer])
    start, end = np.concatenate(starts), np.concatenate(ends)
    return mix64((sums[end] - sums[start]) * inv[start]), np.concatenate(rows)


def word_hash(word: str) -> int:
    """The hash that ``word_hashes`` gives one (lower-cased) word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]))[0][0])


def distinct_per_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table of distinct values, index into it, row) with each value once per row, sorted by row."""
    table, code = np.unique(values, return_inverse=True)
    pair = np.sort(row.astype(np.int64) * max(1, len(table)) + code)
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
    return table, pair % max(1, len(table)), pair // max(1, len(table))


def squeeze(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of which the bytes in ``keep`` (a 256-entry mask) stay and every run of others after one is a space."""
    if not len(data):
        return data, offs
    good = keep[data]
    stay = good.copy()
    stay[1:] |= good[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    stay[inner] = good[inner]  # what another text ends with isn't before this one
    return np.where(good, data, np.uint8(32))[stay], np.r_[0, np.cumsum(stay, dtype=np.int64)][offs]
