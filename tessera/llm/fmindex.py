"""An FM-index over integer texts: suffix array, wavelet matrix of the BWT, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from .bytesets import ranges

#: Texts of up to this many symbols; three numbers of 21 bits are sorted as one.
LONGEST = (1 << 21) - 2
SAMPLE = 8


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of a text whose symbol 0 ends parts: comparison ends there, ends being ordered by place.

    Prefix doubling; in each round only suffixes that are not yet alone in their group are sorted, by (group, group of
    the suffix that follows). The last symbol must be 0.
    """
    n = len(text)
    low = np.uint64(21)
    mask = np.uint64((1 << 21) - 1)
    width = max(1, int(sigma - 1).bit_length())
    m = max(1, 42 // width)
    ends = np.flatnonzero(text == 0)
    end = ends[np.searchsorted(ends, np.arange(n))]
    place = np.arange(n, dtype=np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(m):
        at = np.arange(n) + j
        key = (key << np.uint64(width)) | np.where(at <= end, text[np.minimum(at, n - 1)], 0).astype(np.uint64)
    key = (key << low) | place
    key.sort()
    sa = (key & mask).astype(np.int64)
    key >>= low
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    first |= text[sa] == 0
    follows = np.flatnonzero(text[sa[:-1]] == 0) + 1
    first[follows] = True
    slots = np.arange(n)
    group = np.maximum.accumulate(np.where(first, slots, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    alone = first & np.concatenate([first[1:], [True]])
    active, h = np.flatnonzero(~alone), m
    while len(active):
        i = sa[active]
        after = rank[np.minimum(i + h, end[i])]
        key = (rank[i].astype(np.uint64) << np.uint64(42)) | (after.astype(np.uint64) << low) | i.astype(np.uint64)
        key.sort()
        i = (key & mask).astype(np.int64)
        sa[active] = i
        key >>= low
        first = np.ones(len(i), bool)
        first[1:] = key[1:] != key[:-1]
        start = active[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))]
        rank[i] = start
        active = active[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return sa


class Wavelet:
    """Counts of a symbol before a place, level by level from the highest bit (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.width = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols.astype(np.int32)
        for level in range(self.width - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = self._down(np.arange(1 << self.width), np.zeros(1 << self.width, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i in range(self.width):
            ones = self.ones[i][place]
            place = np.where(symbol >> (self.width - 1 - i) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, place) - self.first[symbol]


class Index:
    """text: symbols 0 (end of a part) to sigma - 1, ending with 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        if len(text) > LONGEST:
            raise ValueError(f"at most {LONGEST} symbols")
        sa = suffix_array(text, sigma)
        self.bwt = text[sa - 1]
        self.wavelet = Wavelet(self.bwt, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.less = np.cumsum(counts) - counts
        # Kept positions: every SAMPLE-th, and the first of each part, as walks don't cross parts.
        kept = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.positions = sa[kept]
        self.size = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (rows of symbols, filled up with zeros)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, position) of every suffix of the ranges, by walking back to kept positions."""
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), count)
        row = ranges(lo, count)
        steps, out = np.zeros(len(row), np.int64), np.empty(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            there = self.kept[r]
            out[live[there]] = self.positions[self.kept_before[r[there]]] + steps[live[there]]
            live, r = live[~there], r[~there]
            c = self.bwt[r]
            row[live] = self.less[c] + self.wavelet.rank(c, r)
            steps[live] += 1
        return which, out
