"""Vectorised views of text columns: lower-casing, words and word hashes on UTF-8 bytes.

A column is taken as one byte buffer with row offsets, in slices of a few MB, so memory does not follow the size of an
Arrow batch. A single text longer than a slice is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word characters by byte (any byte of a multi-byte character counts as one).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[0x20] = False
NON_SPACE[0x09:0x0E] = False

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `target` bytes each."""
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + target, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def parts(array: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a column."""
    raw, off = column(array)
    for lo, hi in slices(off, target):
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and each row's first word (one more entry than rows)."""
    w = inside[data]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = off[off < len(data)]
    first[edge] = w[edge]
    edge = off[off > 0] - 1
    last[edge] = w[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def windows8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, little-endian; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    lens = ends - starts
    win = windows8(data)
    h = mix((win[starts] & _MASK[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _K + np.uint64(seed))
    live, at = np.flatnonzero(lens > 8), 8
    while len(live):
        h[live] = mix(h[live] * _K + (win[starts[live] + at] & _MASK[np.minimum(lens[live] - at, 8)]))
        at += 8
        live = live[lens[live] > at]
    return h


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)
