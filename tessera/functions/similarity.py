"""Indel similarity: 200 * LCS / (len a + len b), on code points; and bounds that no similar pair breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import words


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Pairs whose rows are worked on side by side, and masks that are held at once.
_PAIRS, _MASKS = 1 << 15, 1 << 20


def lcs_of_pairs(left: list[str], right: list[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lcs(left[m[i]], right[n[i]]) for every i, by the same rows, many pairs at once. m ascends; keys may have any length."""
    out = np.zeros(len(m), np.int64)
    if not len(m):
        return out
    codes = lambda keys: (np.frombuffer("".join(keys).encode("utf-32-le"), "<u4"), np.array([len(k) for k in keys], np.int64))
    (x, la), (y, lb) = codes(left), codes(right)
    letters = np.unique(x)
    size, deep = len(letters) + 1, max(-(-int(la.max()) // 64), 1)
    # A letter that no left key has, and the room behind a key's end, are the last letter, which has no mask.
    at = np.minimum(np.searchsorted(letters, y), size - 2)
    table = np.full((len(right), int(lb.max())), size - 1, np.int32)
    inner = np.arange(table.shape[1]) < lb[:, None]
    table[inner] = np.where(letters[at] == y, at, size - 1)
    table = np.ascontiguousarray(table.T)
    start = np.cumsum(la) - la
    step = max(1, _MASKS // (size * deep))
    for lo in range(0, len(left), step):
        hi = min(lo + step, len(left))
        own = np.arange(start[lo], start[lo] + la[lo:hi].sum())
        row = np.repeat(np.arange(hi - lo), la[lo:hi])
        place = own - start[lo:hi][row]
        masks = np.zeros((deep, (hi - lo) * size), np.uint64)
        np.bitwise_or.at(masks, (place >> 6, row * size + np.searchsorted(letters, x[own])), np.uint64(1) << (place & 63).astype(np.uint64))
        first, last = np.searchsorted(m, [lo, hi])
        for k in range(first, last, _PAIRS):
            a, b = m[k : min(k + _PAIRS, last)] - lo, n[k : min(k + _PAIRS, last)]
            base = a * size
            rows = np.full((deep, len(a)), ~np.uint64(0))
            for c in table[: int(lb[b].max())]:
                at, carry = base + c[b], np.uint64(0)
                for word in range(deep):
                    v = rows[word]
                    hit = v & masks[word][at]
                    total = v + hit
                    over = total < v
                    if deep > 1:
                        total += carry
                        carry = (over | (total < carry)).astype(np.uint64)
                    rows[word] = total | (v ^ hit)
            # Bits behind a key's end have no mask, but take carries; they are left out.
            bits = np.clip(la[lo:hi][a] - 64 * np.arange(deep)[:, None], 0, 64)
            kept = np.where(bits > 0, ~np.uint64(0) >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
            out[k : k + len(a)] = la[lo:hi][a] - np.bitwise_count(rows & kept).sum(0)
    return out


def ratio_of(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either side is null. Equal pairs of a batch are scored once."""
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else ratio_of(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def native_ratio(a: Column, b: Column) -> Column:
    """The same in built-in expressions: rows of the table as arrays. Slower; a cross-check."""
    left, right = F.split(a, ""), F.split(b, "")
    left, right = F.when(a == "", F.array()).otherwise(left), F.when(b == "", F.array()).otherwise(right)
    zero = F.array_repeat(F.lit(0), F.length(a) + 1)

    def next_row(row, c):
        step = lambda acc, i: F.concat(acc, F.array(F.when(F.get(left, i) == c, F.get(row, i) + 1).otherwise(F.greatest(F.get(row, i + 1), F.element_at(acc, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.length(a) - 1), F.array(F.lit(0)), step)

    longest = F.element_at(F.aggregate(right, zero, next_row), -1)
    return F.when((a == "") & (b == ""), F.lit(100.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(longest * 200.0 / (F.length(a) + F.length(b)))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def length_bound(a: Column, b: Column, threshold: float) -> Column:
    """LCS is at most the shorter length."""
    return 200 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))


def letter_counts(text: Column, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789 ") -> Column:
    """How often each letter occurs, then all other characters together."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters]
    return F.array(*each, F.length(text) - sum(each[1:], each[0]))


def letters_bound(a: Column, b: Column, total: Column, threshold: float) -> Column:
    """LCS is at most what both have of each letter. a, b: letter_counts; total: the sum of both lengths."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 200 * common >= threshold * total
