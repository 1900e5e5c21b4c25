"""Token ids of whole texts by the tokenizers library, with each distinct segment encoded once a task.

The byte-level splitter always parts a text at certain places, so a text may be cut there and its ids are those of its
segments in order: before a space that a non-space character follows; between an ASCII letter and another ASCII
character; after a lone line feed or tab between non-space characters. Segments are named exactly (integer codes by
comparison of whole bytes, no hashing), and only new ones are given to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd

from .bytesets import _MASK, parts, ranges, windows8

END_ID = 0
#: Segments that a worker's table holds before it is begun anew.
TABLE_SEGMENTS = 500_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x20] = True
#: First bytes after which a cut is safe: ASCII but for white space, and lead bytes under which no white space lies.
_SAFE = np.zeros(256, dtype=bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xE1] = True
_SAFE[0xE4:0xF5] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_OTHER = np.zeros(256, dtype=bool)
_OTHER[:0x80] = ~_LETTER[:0x80]
_BREAK = np.zeros(256, dtype=bool)
_BREAK[0x09:0x0E] = True
_PRINTS = np.zeros(256, dtype=bool)
_PRINTS[0x21:0x7F] = True


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of segments; every byte of every row lies in one."""
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[:-2] = _SPACE[data[:-1]] & _SAFE[data[1:]]
    begin[1:-1] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
    prints = _PRINTS[data]
    begin[2:-1] |= prints[:-2] & _BREAK[data[1:-1]] & prints[2:]
    begin[off] = True
    starts = np.flatnonzero(begin)
    return starts[:-1], starts[1:]


def name_exactly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An integer for each byte range, equal where the bytes are, and the first range of each integer."""
    lens = ends - starts
    win = windows8(data)
    key = (win[starts] & _MASK[np.minimum(lens, 7)]) | (np.minimum(lens, 8).astype(np.uint64) << np.uint64(56))
    code, _ = pd.factorize(key)
    code = code.astype(np.int64)
    live, at = np.flatnonzero(lens > 7), 7
    while len(live):
        left = lens[live] - at
        piece, _ = pd.factorize((win[starts[live] + at] & _MASK[np.minimum(left, 7)]) | (np.minimum(left, 8).astype(np.uint64) << np.uint64(56)))
        # A name made of (former name, next bytes), apart from the names of ended ranges.
        both, _ = pd.factorize((code[live] << 32) | piece)
        code[live] = both + int(code.max()) + 1
        at += 7
        live = live[lens[live] > at]
    code, uniques = pd.factorize(code)
    first = np.empty(len(uniques), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, first


def encoder(tokenizer_path: str) -> Encoder:
    """The encoder of this Python worker, which keeps its table while the worker serves further tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if tokenizer_path not in kept:
        kept[tokenizer_path] = Encoder(tokenizer_path)
    return kept[tokenizer_path]


class Encoder:
    """Encodes slices of a text column."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.sizes = np.zeros(0, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Segments that begin with a space are encoded as one text, of which each is again a segment; others alone."""
        led = [k for k in new if len(k) > 1 and k[0] == 0x20 and k[1] != 0x20 and k[-1] > 0x20]
        rest = [k for k in new if not (len(k) > 1 and k[0] == 0x20 and k[1] != 0x20 and k[-1] > 0x20)]
        got = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in [b"".join(led), *rest]], add_special_tokens=False)
        ids = np.fromiter((i for enc in got for i in enc.ids), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, led + rest), np.int64, len(new)))
        starts = np.zeros(len(new) + 1, np.int64)
        starts[1 : len(led) + 1] = np.searchsorted(np.cumsum(self.token_bytes()[np.array(got[0].ids, np.int64)]), ends[: len(led)], "right")
        starts[len(led) + 1 :] = len(got[0].ids) + np.cumsum([len(enc) for enc in got[1:]]) if rest else 0
        n, m = len(self.table), len(self.table) + len(new)
        while m > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n:m], self.count[n:m] = self.used + starts[:-1], np.diff(starts)
        self.used += len(ids)
        self.table.update(zip(led + rest, range(n, m)))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and each row's first id (one more entry than rows)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.table) > TABLE_SEGMENTS:
            self._clear()
        starts, ends = cuts(data, off)
        code, first = name_exactly(data, starts, ends)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if new := [k for k in keys if k not in self.table]:
            self._learn(new)
        entry = np.array(list(map(self.table.__getitem__, keys)), np.int64)[code]
        count = self.count[entry]
        ids = self.flat[ranges(self.start[entry], count)]
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        return ids, upto[np.searchsorted(starts, off)]

    def token_bytes(self) -> np.ndarray:
        """The number of bytes of each id's text (byte-level vocabularies: one character a byte)."""
        if not len(self.sizes):
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.sizes[i] = len(token)
        return self.sizes


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Puts the end id after each row's ids."""
    rows = len(at) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    lens = np.diff(at)
    to = at + np.arange(rows + 1)
    out[ranges(to[:-1], lens)] = ids
    return out, to


def encoded(by: Encoder, array, target: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids with end ids, row offsets) for each slice of a text column."""
    for lo, hi, data, off in parts(array, target):
        ids, at = by.encode(data, off)
        yield lo, hi, *with_end(ids, at)
