"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, parts, windows8
from .common import batch, with_fields

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Small slices keep the n-gram arrays in the processor's cache.
SLICE = 1 << 20

_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4
_MASK32 = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x61:0x7B] = _ASCII_LETTER[0x41:0x5B] = True


def grams(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram at each character (BUCKETS where it would leave its text); and each
    row's first character. Characters are taken as their UTF-8 bytes; A-Z are lower-cased."""
    low = LOWER[data]
    head = np.flatnonzero((low & 0xC0) != 0x80)
    at = np.searchsorted(head, off)
    key = windows8(low)[head].astype(np.uint32) & _MASK32[_CHAR_BYTES[low[head]]]
    rows = np.flatnonzero(np.diff(at))
    out, h = [], np.zeros(len(key), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(key), np.uint32)
        shifted[: len(key) - n + 1] = key[n - 1 :]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            b = ((h * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.int64)
            for back in range(1, n):
                ends = at[rows + 1] - back
                b[ends[ends >= at[rows]]] = BUCKETS
            out.append(b)
    return out, at


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter (of any script)."""
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=upto[1:])
    found = np.diff(upto[off]) > 0
    for row in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[row] = any(map(str.isalpha, data[off[row] : off[row + 1]].tobytes().decode("utf-8", "replace")))
    return found


@dataclass
class Model:
    languages: list[str]
    #: Languages x buckets; the last column is of n-grams that leave their text.
    log_prob: np.ndarray
    log_prior: np.ndarray


def train(docs: DataFrame, usable: Column, max_languages: int = 1000, smoothing: float = 0.5) -> Model:
    """Counts over all usable rows with a language. Each task sums its own rows; what reaches the driver are counts by
    language and bucket, whatever the size of the corpus. max_languages: beyond it the matrix would be too large, and
    training fails. Null or empty texts add nothing but a row to their language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for lo, hi, data, off in parts(b.column("text"), SLICE):
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                by_order, at = grams(data, off)
                label = np.repeat(code, np.diff(at)) * (BUCKETS + 1)
                sums = np.zeros(len(names) * (BUCKETS + 1), np.int64)
                for bucket in by_order:
                    sums += np.bincount(label + bucket, minlength=len(sums))
                sums = sums.reshape(len(names), BUCKETS + 1)
                sums[:, BUCKETS] = np.bincount(code, minlength=len(names))  # documents
                for name, row in zip(names.tolist(), sums):
                    totals[name] = totals[name] + row if name in totals else row.copy()
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield batch(lang=pa.array([name] * len(at)), bucket=pa.array(at.astype(np.int32)), n=pa.array(row[at]))

    rows = docs.where(usable & F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; at most {max_languages} are allowed")
    place = {x: i for i, x in enumerate(languages)}
    n = np.zeros((len(languages), BUCKETS + 1))
    if len(languages):
        n[[place[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    rows_by = n[:, BUCKETS].copy()
    n = n[:, :BUCKETS] + smoothing
    log_prob = np.zeros((len(languages), BUCKETS + 1))
    log_prob[:, :BUCKETS] = np.log(n / n.sum(1, keepdims=True)) if len(languages) else 0
    return Model(languages, log_prob, np.log(rows_by / max(rows_by.sum(), 1)))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then lang_pred and score (the posterior of the predicted language, 0 to 1).

    `und` with score 0 where the text is null or has no letter, or nothing was learned; of equal posteriors the language
    that sorts first. The model, of at most max_languages x 65,537 numbers, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.log_prob, model.log_prior))
    fields = {f.name: f for f in docs.select(*keep).schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_prob, log_prior = shared.value
        names = np.array([*languages, "und"], dtype=object)
        for b in batches:
            best, top = np.full(b.num_rows, len(languages)), np.zeros(b.num_rows)
            for lo, hi, data, off in parts(b.column("text"), SLICE):
                if not len(languages) or not len(data):
                    continue
                by_order, at = grams(data, off)
                rows = np.flatnonzero(np.diff(at))
                logp = np.tile(log_prior, (hi - lo, 1))
                for bucket in by_order:
                    for k in range(len(languages)):
                        logp[rows, k] += np.add.reduceat(log_prob[k][bucket], at[rows])
                letters = has_letter(data, off)
                first = logp.argmax(1)
                share = 1 / np.exp(logp - logp.max(1, keepdims=True)).sum(1)
                best[lo:hi] = np.where(letters, first, len(languages))
                top[lo:hi] = np.where(letters, share, 0.0)
            kept = {c: b.column(c) for c in fields}
            yield batch(**kept, lang_pred=pa.array(names[best], pa.string()), score=pa.array(top))

    schema = with_fields(list(fields.values()), "lang_pred string, score double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, schema)
