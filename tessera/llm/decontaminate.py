"""Benchmark decontamination by an FM-index per shard of training text.

A shard is a few MB of texts as a sequence of words: words of the benchmark by number, every run of other words as one
symbol that no phrase has, and an end after each document. Phrases (windows of consecutive benchmark words) are searched
backwards, occurrences are located by sampled positions, a second hash of their words confirms them, and their words are
merged into the spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ALNUM, LOWER, column, hashes, parts, ranges, words
from .common import batch, tidied, unwrap, with_fields, wrap
from .fmindex import LONGEST, Index

#: Benchmarks above this size don't fit into the memory of a worker next to an index.
MAX_BENCHMARK_BYTES = 256 << 20


@dataclass
class Phrases:
    words: np.ndarray  # hashes of the benchmark's words, ascending; a word's symbol is its place + 2
    checks: np.ndarray  # second hashes
    patterns: np.ndarray  # symbols, a row a phrase
    lengths: np.ndarray
    owners: np.ndarray  # (phrase, item) pairs, ascending
    items: list[str]


def phrases(benchmark: DataFrame, window: int) -> Phrases:
    """Distinct windows of all items. Null texts and texts without words have none; rows without item_id are left out;
    rows that repeat an item_id are one item."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_BENCHMARK_BYTES} are allowed")
    table = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").toArrow()
    raw, off = column(table.column("text"))
    low = LOWER[raw]
    starts, ends, at = words(low, off, ALNUM)
    word = hashes(low, starts, ends)
    known, first = np.unique(word, return_index=True)
    checks = hashes(low, starts[first], ends[first], 99)
    symbols = np.searchsorted(known, word) + 2
    names = sorted(set(table.column("item_id").to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    seen: dict[bytes, int] = {}
    rows, owners = [], set()
    for name, a, b in zip(table.column("item_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
        for i in range(a, max(a, b - window) + 1 if b > a else a):
            p = symbols[i : min(i + window, b)]
            k = seen.setdefault(p.tobytes(), len(seen))
            if k == len(rows):
                rows.append(p)
            owners.add((k, number[name]))
    patterns = np.zeros((len(rows), window), np.int32)
    for k, p in enumerate(rows):
        patterns[k, : len(p)] = p
    return Phrases(known, checks, patterns, np.array([len(p) for p in rows], np.int64), np.array(sorted(owners), np.int64).reshape(-1, 2), names)


class _Lookup:
    """Places of hashes in a sorted list, by a table on their upper bits where no two share an entry."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.uint64(64 - min(20, max(10, int(4 * len(known)).bit_length())))
        slot = (known >> self.bits).astype(np.int64)
        size = 1 << (64 - int(self.bits))
        self.table = np.full(size, -1, np.int64)
        self.table[slot] = np.arange(len(known))
        self.many = np.bincount(slot, minlength=size) > 1

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), -1, np.int64)
        slot = (h >> self.bits).astype(np.int64)
        out = self.table[slot]
        again = np.flatnonzero(self.many[slot])
        out[again] = np.minimum(np.searchsorted(self.known, h[again]), len(self.known) - 1)
        out[self.known[out] != h] = -1
        return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then for every row: n_words, n_hit (words inside any occurrence of a phrase), items (names of
    items with an occurring phrase, ascending), spans (start, end in characters of each run of hit words) and clean (the
    text without its spans; null if there are none).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, after A-Z are lower-cased. A phrase is a
    window of consecutive words of an item, or all its words if it has fewer. A null text has no words. An empty
    benchmark hits nothing.
    """
    sought = phrases(benchmark, window)
    # Plain arrays, which executors can load without this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(sought))
    fields = {f.name: f for f in docs.select(*keep).schema.fields}

    def occurrences(symbols: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word place) pairs in a sequence of symbols, indexed in pieces that overlap by a phrase."""
        other = symbols == 1
        drop = np.zeros(len(symbols), bool)
        drop[1:] = other[1:] & other[:-1]
        place = np.flatnonzero(~drop)
        text = symbols[place]
        which, where = [], []
        step = LONGEST - window - 1
        for lo in range(0, len(text), step):
            piece = np.append(text[lo : lo + step + window], 0)
            index = Index(piece, len(p.words) + 2)
            k, at = index.locate(*index.search(p.patterns, p.lengths))
            which.append(k)
            where.append(place[at + lo])
        return (np.concatenate(which), np.concatenate(where)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = SimpleNamespace(**shared.value)
        lookup = _Lookup(p.words)
        for b in batches:
            n_words, n_hit = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            items: list[list[str]] = [[] for _ in range(b.num_rows)]
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            clean: list[str | None] = [None] * b.num_rows
            for lo, hi, data, off in parts(b.column("text")):
                low = LOWER[data]
                starts, ends, at = words(low, off, ALNUM)
                n_words[lo:hi] = np.diff(at)
                if not len(starts) or not len(p.patterns):
                    continue
                # Symbols with an end after each row; `of_word` takes a symbol's place to its word's.
                rows = np.arange(hi - lo)
                symbols = np.zeros(len(starts) + len(rows), np.int64)
                row_of = np.repeat(rows, np.diff(at))
                symbols[np.arange(len(starts)) + row_of] = np.maximum(lookup.find(hashes(low, starts, ends)), -1) + 2
                row_of_symbol = np.zeros(len(symbols), np.int64)
                row_of_symbol[np.arange(len(starts)) + row_of] = row_of
                which, where = occurrences(symbols, p)
                if not len(which):
                    continue
                row = row_of_symbol[where]
                first, n = where - row, p.lengths[which]
                # Confirmed by the second hash of each word.
                w = ranges(first, n)
                same = hashes(low, starts[w], ends[w], 99) == p.checks[p.patterns[np.repeat(which, n), w - np.repeat(first, n)] - 2]
                good = np.logical_and.reduceat(same, np.cumsum(n) - n)
                which, row, first, n = which[good], row[good], first[good], n[good]
                edge = np.bincount(first, minlength=len(starts) + 1) - np.bincount(first + n, minlength=len(starts) + 1)
                hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                n_hit[lo:hi] = np.bincount(row_of[hit], minlength=hi - lo)
                # Items by row: each phrase's owners.
                a, z = np.searchsorted(p.owners[:, 0], which), np.searchsorted(p.owners[:, 0], which, "right")
                found = np.unique(np.repeat(row, z - a) * len(p.items) + p.owners[ranges(a, z - a), 1])
                for x in found.tolist():
                    items[lo + x // len(p.items)].append(p.items[x % len(p.items)])
                # Runs of hit words of one row.
                begins = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row_of[hit]) > 0)]) if len(hit) else np.zeros(0, bool)
                run_at = np.flatnonzero(begins)
                last = np.append(run_at[1:], len(hit)) - 1
                by_row: dict[int, list[tuple[int, int]]] = {}
                for r, s, e in zip(row_of[hit[run_at]].tolist(), starts[hit[run_at]].tolist(), ends[hit[last]].tolist()):
                    by_row.setdefault(r, []).append((s - int(off[r]), e - int(off[r])))
                for r, cuts in by_row.items():
                    text = data[off[r] : off[r + 1]].tobytes()
                    done, left = 0, []
                    for s, e in cuts:
                        left.append(text[done:s])
                        done = e
                    clean[lo + r] = b"".join([*left, text[done:]]).decode("utf-8", "replace")
                    chars = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))
                    spans[lo + r] = [{"start": int(chars[s]), "end": int(chars[e])} for s, e in cuts]
            kept = {c: b.column(c) for c in fields}
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield batch(**kept, n_words=pa.array(n_words), n_hit=pa.array(n_hit), items=pa.array(items, pa.list_(pa.string())), spans=pa.array(spans, span), clean=pa.array(clean, pa.string()))

    schema = with_fields(list(fields.values()), "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>, clean string")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs, with their own columns, their texts without the spans that hold benchmark phrases."""
    found = find(wrap(docs), benchmark, window, ("row", "text"))
    return unwrap(found, F.coalesce("clean", "text"))
