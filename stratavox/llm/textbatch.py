"""Whole-batch text arithmetic: Arrow string columns as flat UTF-8 bytes with document offsets.

The helpers keep a task's memory to a few slices of ``SLICE_BYTES``, whatever the Arrow batch holds;
a document longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: The same where a byte of text takes many numbers.
SMALL_SLICE = 1 << 19

#: Word separators 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240611)
#: A fixed 64-bit value for each byte.
BYTE_VALUE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if not len(off):
        off = np.zeros(1, dtype=np.int64)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (or one row)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (one value a byte) by document."""
    c = np.zeros(len(flags) + 1, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def spans(in_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``in_word`` within documents, and each document's first run (offsets)."""
    n = len(in_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[off] = True
    start = in_word.copy()
    start[1:] &= ~in_word[:-1] | border[1:n]
    end = in_word.copy()
    end[:-1] &= ~in_word[1:] | border[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SMALL_SLICE + 1)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers.append(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values each, len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0xA24BAED4963EE407) + h[j : j + m]
    return mix(out)
