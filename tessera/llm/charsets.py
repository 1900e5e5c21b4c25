"""Sets of character shingles of many lines at once, as sorted hashes.

Characters are taken as their UTF-8 bytes, so nothing is decoded. A line shorter than a shingle is one shingle.
"""

from __future__ import annotations

import numpy as np

from .bytesets import mix

SHINGLE = 5
#: Upper bits of a hash that name a shingle outside of its line.
NAME_BITS = 44

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, and each line's first character (one more entry than lines). Bytes that are not UTF-8
    are characters of their own."""
    if not (data & 0x80).any():
        return data.astype(np.uint64), at
    text = [data[a:b].tobytes().decode("utf-8", "surrogateescape") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return code, np.concatenate([[0], np.cumsum(list(map(len, text)), dtype=np.int64)])


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle, repeats too. at: the lines' places in data; no line is empty."""
    code, first = characters(data, at)
    size = np.diff(first)
    # Two characters are one number of 42 bits; five are hashed as 2 + 2 + 1.
    code = np.concatenate([code, np.zeros(SHINGLE - 1, np.uint64)])
    two = code[:-1] << np.uint64(21)
    two |= code[1:]
    h = two[:-3] * _K1
    h ^= h >> np.uint64(29)
    h += two[2:-1]
    h *= _K2
    h += code[4:]
    short = np.flatnonzero(size < SHINGLE)
    if len(short):
        # A line of up to four characters is two numbers of 42 bits, mixed one after the other, and its length.
        at, n = first[short], size[short].astype(np.uint64)
        c = [np.where(size[short] > i, code[at + i], 0).astype(np.uint64) for i in range(SHINGLE - 1)]
        low = mix((c[0] << np.uint64(21) | c[1]) * _K1 + n)
        h[at] = mix((low + (c[2] << np.uint64(21) | c[3])) * _K2 + n)
    h = mix(h)
    counts = np.maximum(size - SHINGLE + 1, 1)
    kept = np.ones(len(h), bool)
    for back in range(1, SHINGLE):
        kept[first[1:][size > back] - back] = False
    kept[first[:-1]] = True
    return np.repeat(np.arange(len(size), dtype=np.uint64), counts), h[kept]


def sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct shingles of all lines as (line << bits) | upper bits of the hash, ascending; each line's first place
    (one more entry than lines); bits."""
    line, h = shingles(data, at)
    rows = len(at) - 1
    bits = min(64 - max(rows, 1).bit_length(), 54)
    key = line << np.uint64(bits)
    key |= h >> np.uint64(64 - bits)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key, np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(bits)), bits


def similar(data: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For lines in pairs (the first with the second, the third with the fourth ...): whether 100 * intersection >=
    percent * union of their sets."""
    key, first, bits = sets(data, at)
    n = np.diff(first)
    mask = np.uint64((1 << bits) - 1)
    pair = (np.repeat(np.arange(len(n)), n) // 2).astype(np.uint64)
    both = np.sort((pair << np.uint64(bits)) | (key & mask))
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(bits)).astype(np.int64), minlength=len(n) // 2)
    return (100 + percent) * shared >= percent * (n[0::2] + n[1::2])
