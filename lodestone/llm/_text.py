"""Arrow/numpy kernels over whole batches of texts.

Every kernel works on the UTF-8 buffer of an Arrow string column, so a batch costs a fixed number of numpy passes
whatever the number of its rows; nothing here loops over words or characters.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts whose bytes go through the kernels together; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns freed memory to the system: executors run a worker for each core, and allocators keep what a batch needed."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def strings(column: pa.Array) -> pa.LargeStringArray:
    """The column as large strings without nulls (a null text counts as an empty one); called once a batch."""
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "").cast(pa.large_string())


def buffer(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; offsets[0] is 0."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.LargeStringArray, size: int = BLOCK_BYTES):
    """(first row, rows) of runs of texts that together hold about `size` bytes."""
    _, offsets = buffer(column)
    start, n = 0, len(column)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, column.slice(start, end - start)
        start = end


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n + 1, _INVERSE if inverse else _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; sizes are rounded up so that the tables are shared."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, inverse)[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of each data[start:end]; equal bytes hash equally wherever they stand. Another table of odd numbers gives another hash."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * powers(len(data))[:-1], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(len(data), True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of maximal runs of kept bytes; a run never crosses a row's end."""
    n = len(keep)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = keep[0]
    first[1:] = keep[1:] & ~keep[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = keep[edges]
    last = np.empty(n, bool)
    last[-1] = keep[-1]
    last[:-1] = keep[:-1] & ~keep[1:]
    last[edges - 1] = keep[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, row) of the runs of letters and digits of the lower-cased texts."""
    data, offsets = buffer(pc.utf8_lower(column))
    return data, *runs(_WORD[data], offsets)


def distinct_rows(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, sorted by row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


_LANES = np.array([[(b >> (7 - i)) & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def bit_counts(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many values each row has, how many of them have each of the 64 bits); row is sorted.

    Eight bits are counted at once in the bytes of a 64-bit word, over at most 255 values, then the counts are added up.
    """
    total, count = np.zeros((rows, 64), np.int64), np.bincount(row, minlength=rows)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        part = np.flatnonzero(place % 255 == 0)
        sums = np.empty((len(part), 64), np.uint8)
        octets = value.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            sums[:, 8 * j : 8 * j + 8] = np.add.reduceat(_LANES[octets[:, j]], part).view(np.uint8).reshape(-1, 8)
        owner = row[part]
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[head]] = np.add.reduceat(sums, head, axis=0, dtype=np.int64)
    return count, total
