"""Array kernels over the flat UTF-8 buffer of an Arrow string column.

A column is one byte buffer plus offsets.  Finding words, hashing them and
gathering variable-length pieces are then a few numpy passes over the buffer,
instead of Python objects for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space and ASCII punctuation.
MARKS = SPACE.copy()
MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

CHUNK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20


@cache
def _libc():
    """The C library with a fixed threshold from which arrays are mapped, so freed ones leave the process."""
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        lib.malloc_trim  # noqa: B018
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):  # another C library
        return None
    return lib


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task body of bounded memory.

    Texts come in Arrow batches of ``BATCH_BYTES`` rather than of many rows, on
    both sides of the pipe, and the worker, which Spark reuses, gives memory back
    when the task ends.  The limit is the session's (Spark has none for one plan); one
    that the user has set stays.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def body(batches):
        lib = _libc()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if lib is not None:
            lib.malloc_trim(0)

    return body


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str | int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches so that the text of each has about ``most`` bytes at most (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the number of its first word (and the total).

    ``gap`` marks the byte values that separate words.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~gap[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span, all in one pass (sums of salted bytes times powers of an odd base).

    It is a key for grouping; callers verify bytes where equality must be exact.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SALT[buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads the high bits to all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def strings(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow binary array over a flat buffer."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())
