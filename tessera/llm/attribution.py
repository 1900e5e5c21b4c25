"""Token counts by section: whole documents are encoded once, and tokens go to sections by their character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesets import parts
from .common import batch
from .encode import encoder

RULES = ("first", "last", "most")


def attribute(docs: DataFrame, tokenizer_path: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """Token counts of the sections of every text.

    Sections are the parts that `separator` (one ASCII character) ends; it belongs to the section that it ends. A token's
    span runs from its first character to its last; a token that crosses boundaries goes whole to the section of its
    first character ("first"), of its last ("last"), or to the one that holds most of its bytes, the earlier of equals
    ("most"). Every token is counted once: the counts of a document add up to its tokens.

    One row a section: doc_id, section_no, start, end (characters), n_tokens, n_crossing (tokens counted here that reach
    into another section), doc_tokens. An empty or null text has one empty section. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    mark = ord(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(tokenizer_path)
        sizes = by.token_bytes()
        for b in batches:
            doc_ids = np.array(b.column("doc_id").to_pylist(), dtype=object)
            for lo, hi, data, off in parts(b.column("text")):
                ids, at = by.encode(data, off)
                ends = np.cumsum(sizes[ids])
                begins = ends - sizes[ids]
                # Sections of all rows as intervals of the slice's bytes, one after the other.
                stops = np.flatnonzero(data == mark) + 1
                inner = stops[~np.isin(stops, off[1:])]
                rows_end = off[1:]
                cut = np.sort(np.concatenate([inner, rows_end]), kind="stable")
                starts = np.concatenate([[0], cut[:-1]])
                row = np.searchsorted(rows_end, cut, "left")
                # Empty rows end where others do: each keeps its one empty section.
                empty = np.flatnonzero(np.diff(off) == 0)
                row = np.sort(np.concatenate([row[cut > starts], empty]), kind="stable")
                full = cut > starts
                filled = np.ones(len(row), bool)
                firsts = np.searchsorted(row, np.arange(hi - lo))
                filled[firsts[empty]] = False
                sec_start, sec_end = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
                sec_start[filled], sec_end[filled] = starts[full], cut[full]
                sec_start[~filled] = sec_end[~filled] = off[empty]
                places = np.flatnonzero(filled)
                bounds = sec_end[places]
                head = np.searchsorted(bounds, begins, "right")
                tail = np.searchsorted(bounds, ends - 1, "right")
                if rule == "first":
                    own = head
                elif rule == "last":
                    own = tail
                else:
                    own = head.copy()
                    for t in np.flatnonzero(tail > head):
                        inside = [min(int(ends[t]), int(bounds[s])) - max(int(begins[t]), int(bounds[s - 1]) if s else 0) for s in range(head[t], tail[t] + 1)]
                        own[t] = head[t] + int(np.argmax(inside))
                n, crossing = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                n[places] = np.bincount(own, minlength=len(places))
                crossing[places] = np.bincount(own[tail > head], minlength=len(places))
                # Bytes to characters: continuation bytes are not counted.
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                base = chars[off[row]]
                yield batch(
                    doc_id=pa.array(doc_ids[lo + row], pa.int64()),
                    section_no=pa.array((np.arange(len(row)) - firsts[row]).astype(np.int32)),
                    start=pa.array(chars[sec_start] - base),
                    end=pa.array(chars[sec_end] - base),
                    n_tokens=pa.array(n),
                    n_crossing=pa.array(crossing),
                    doc_tokens=pa.array(np.diff(at)[row]),
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, section_no int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
