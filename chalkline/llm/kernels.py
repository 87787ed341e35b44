"""Vectorised text kernels over Arrow buffers.

Everything here works on the UTF-8 bytes of a block of rows at once, so no
Python string is made for a row or a word. Separators are ASCII, which makes
byte positions safe in UTF-8. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: The white space that parts words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BASE2 = _U(0xD6E8FEB86659FD93)
_BASE2_INV = _U(pow(int(_BASE2), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTES2 = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(0xABCD))


@lru_cache(maxsize=8)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    a, b = (_BASE2, _BASE2_INV) if second else (_BASE, _BASE_INV)
    make = _powers if size <= 1 << 22 else _powers.__wrapped__
    return make(size, int(a)), make(size, int(b))


def running(values: np.ndarray, second: bool = False) -> np.ndarray:
    """Prefix sums for span_hash: values[i] * base^i."""
    up, _ = powers(len(values), second)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], dtype=_U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the spans [start, end) of the sequence that running() took."""
    _, down = powers(len(sums), second)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi), their bytes and their offsets in these bytes, about size bytes at a time."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a block: start and end byte of each, and in first[r]:first[r + 1] the words of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = inside.copy(), np.zeros(len(data), bool)
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:] = inside
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, second: bool = False) -> np.ndarray:
        """Of the words; the second ones come from another byte table and base."""
        return span_hash(running((_BYTES2 if second else _BYTES)[self.data], second), self.start, self.end, second)

    def windows(self, k: int) -> np.ndarray:
        """Indices of the words that start a window of k words of one row."""
        i = np.arange(len(self.start) - k + 1) if len(self.start) >= k else np.zeros(0, np.int64)
        return i[self.row[i] == self.row[i + k - 1]] if len(i) else i


def byte_sums(data: np.ndarray, second: bool = False) -> np.ndarray:
    return running(_BYTES[data], second)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces between \\n; an empty text has one empty piece."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], cut]), kind="stable")
    pieces = np.searchsorted(cut, offsets[1:]) - np.searchsorted(cut, offsets[:-1]) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), pieces)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
