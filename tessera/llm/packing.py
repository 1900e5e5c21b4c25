"""Harmonic packing of token sequences.

A piece of s ids belongs to the class k whose bins of `capacity` ids take k of it: the largest listed k with
s <= capacity // k. Bins of class k are closed after k pieces, whatever else is packed; no bin needs to know of another,
so each worker fills its own, without a shuffle, in memory bounded by the capacity.

Documents may be cut, so each is cut into pieces that fill their class: whole bins first, then the largest reciprocal
part that the rest holds, until the rest fills its own class but for `waste`. What a worker has in unfilled bins at its
end (fewer than k pieces a class) is laid end to end and cut at the capacity; the very last part is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch, binaries, tidied
from .encode import encoded, encoder

#: Classes by documents per bin: all small counts, then powers of two.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 32, 64, 128, 256, 512, 1024)

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, class int, ids binary"


def cut_plan(capacity: int, waste: float) -> list[list[tuple[int, int]]]:
    """For each rest r below the capacity: its pieces as (size, class)."""
    classes = [k for k in CLASSES if k <= capacity]
    plan: list[list[tuple[int, int]]] = [[]]
    for r in range(1, capacity + 1):
        k = max(k for k in classes if capacity // k >= r)
        if r == capacity // k or r * k >= (1 - waste) * capacity:
            plan.append([(r, k)])
        else:
            k = min(k for k in classes if capacity // k <= r)
            plan.append([(capacity // k, k), *plan[r - capacity // k]])
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, waste: float = 0.01) -> DataFrame:
    """Packs whole documents (ids of `text`, then the end id) into sequences of at most `capacity` ids.

    One row a piece: doc_id, start and length in its document, doc_tokens, sequence_id, offset (there, gapless from 0),
    class (1: the piece's own bin; 0: laid end to end), ids (little-endian unsigned 32-bit). A null or empty text is the
    end id alone; a repeated row is a document of its own; a null doc_id is kept; other columns are ignored. Sequence ids
    hold the number of the input partition, so they are unique, and the same when a task is repeated over the same rows.
    """
    plan = cut_plan(capacity, waste)
    lengths = [np.array([s for s, _ in p], np.int64) for p in plan]
    kinds = [np.array([k for _, k in p], np.int64) for p in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 40
        open_bins: dict[int, list] = {}  # class: [sequence_id, pieces so far, ids so far, the pieces]

        def emit(pieces: list[tuple], chunks: list[np.ndarray]) -> pa.RecordBatch:
            doc, start, length, tokens, seq, offset, kind = (pa.array(c, t) for c, t in zip(zip(*pieces), (*[pa.int64()] * 6, pa.int32())))
            at = np.zeros(len(pieces) + 1, np.int64)
            np.cumsum([len(c) for c in chunks], out=at[1:])
            return batch(doc_id=doc, start=start, length=length, doc_tokens=tokens, sequence_id=seq, offset=offset, **{"class": kind}, ids=binaries(np.concatenate(chunks).tobytes(), at * 4))

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, ids, at in encoded(by, b.column("text")):
                out: list[tuple] = []
                chunks: list[np.ndarray] = []
                for row in range(lo, hi):
                    a, n = int(at[row - lo]), int(at[row - lo + 1] - at[row - lo])
                    whole = n // capacity
                    sizes = [capacity] * whole + lengths[n % capacity].tolist()
                    classes = [1] * whole + kinds[n % capacity].tolist()
                    start = 0
                    for size, k in zip(sizes, classes):
                        chunk = ids[a + start : a + start + size]
                        if k == 1:
                            out.append((doc_ids[row], start, size, n, next_id, 0, 1))
                            chunks.append(chunk)
                            next_id += 1
                        else:
                            full = open_bins.setdefault(k, [])
                            full.append((doc_ids[row], start, size, n, chunk.copy()))
                            if len(full) == k:
                                offset = 0
                                for d, s, m, t, c in full:
                                    out.append((d, s, m, t, next_id, offset, k))
                                    chunks.append(c)
                                    offset += m
                                next_id += 1
                                full.clear()
                        start += size
                if out:
                    yield emit(out, chunks)
        left = [piece for k in sorted(open_bins) for piece in open_bins[k]]
        total = sum(p[2] for p in left)
        bounds = [capacity] * (total // capacity) + [1 << i for i in range(capacity.bit_length(), -1, -1) if (total % capacity) >> i & 1]
        out, chunks, offset = [], [], 0
        for d, s, m, t, c in left:
            while m:
                take = min(m, bounds[0] - offset)
                out.append((d, s, take, t, next_id, offset, 0))
                chunks.append(c[:take])
                s, m, c, offset = s + take, m - take, c[take:], offset + take
                if offset == bounds[0]:
                    bounds.pop(0)
                    next_id, offset = next_id + 1, 0
        if out:
            yield emit(out, chunks)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(tidied(run), SCHEMA)
