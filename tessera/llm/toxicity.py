"""A toxicity classifier that is kept from reading identity terms as insults.

Logistic regression over the distinct hashed words and word beginnings of a text. Labelled texts that name a group get
counterfactuals, in which the term is swapped for others of its set and for a neutral one; the squared difference of the
two scores (as log-odds) is added to the loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import ALNUM, LOWER, column, hashes, parts, words
from .common import batch, tidied, unwrap, with_fields, wrap

BITS = 18
PREFIX = 5

#: Sets of identity terms that may be swapped; the first of each is neutral.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "transgender"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("persons", "black", "white", "asian", "latino", "arab"),
    ("adults", "gay", "lesbian", "straight", "bisexual"),
    ("residents", "immigrants", "refugees", "foreigners", "natives"),
    ("patients", "disabled", "deaf", "blind", "autistic"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "gitanos", "inmigrantes"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer"),
)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's feature, and the feature of its beginning (that of the word where it has no more than PREFIX bytes)."""
    whole = hashes(data, starts, ends, 1) >> np.uint64(64 - BITS)
    head = hashes(data, starts, np.minimum(ends, starts + PREFIX), 2) >> np.uint64(64 - BITS)
    return whole.astype(np.int64), head.astype(np.int64)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row in ascending order, and each row's first place."""
    low = LOWER[data]
    starts, ends, at = words(low, off, ALNUM)
    whole, head = word_features(low, starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at)) << BITS
    key = np.sort(np.concatenate([row | whole, row | head]))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(off)) << BITS)


def _term_table(sets: Sequence[Sequence[str]]) -> dict[bytes, list[bytes]]:
    out: dict[bytes, list[bytes]] = {}
    for terms in sets:
        for t in terms[1:]:
            out.setdefault(t.encode(), []).extend(x.encode() for x in terms if x != t)
    return out


def swaps(text: bytes, table: dict[bytes, list[bytes]]) -> list[tuple[bytes, bytes]]:
    """(term, other term) for each swap that a text allows."""
    import re

    found = {w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.lower()) if w in table}
    return [(t, o) for t in sorted(found) for o in table[t]]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sample(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = 10_000) -> DataFrame:
    """doc_id, text, toxic of labelled usable documents: at most max_per_class of each class, those whose hashed ids are
    smallest. A document with several labels counts as toxic if one says so; null labels are left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(max_per_class).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_per_class))
    # At most 2 * max_per_class rows of two numbers are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def screen(flat: np.ndarray, label: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each feature, the likelihood-ratio statistic (G) of its presence against the label."""
    n1, n0 = float(rows.sum()), float(len(rows) - rows.sum())
    a = np.bincount(flat, label, 1 << BITS)
    b = np.bincount(flat, minlength=1 << BITS) - a
    k, n = a + b, n1 + n0

    def term(seen, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / expected), 0.0)

    return 2 * (term(a, k * n1 / n) + term(b, k * n0 / n) + term(n1 - a, (n - k) * n1 / n) + term(n0 - b, (n - k) * n0 / n))


def train(sampled: DataFrame, prior: float | None = None, sets: Sequence[Sequence[str]] = IDENTITY_SETS, counterfactual: float = 1.0, l2: float = 2e-5, least_g: float = 16.0, epochs: int = 20, rate: float = 0.3) -> Model:
    """Fits the weights on the driver, on a bounded sample (see `sample`). counterfactual: the weight of the penalty on
    score changes under swaps. least_g: only features whose presence tells the classes apart that well (likelihood-ratio
    statistic) get a weight, so that a small sample isn't learned by heart. prior: the share of toxic documents to which scores are moved; that of the sample if None.
    With labels of one class only, every score is that class's share."""
    table = _term_table(sets)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(word: bytes) -> list[int]:
            raw = np.frombuffer(word, np.uint8)
            w, h = word_features(raw, np.array([0]), np.array([len(raw)]))
            return [int(w[0]), int(h[0])]

        for b in batches:
            raw, off = column(b.column("text"))
            feats, at = features(raw, off)
            text = raw.tobytes()
            minus, plus = [], []
            for row in range(b.num_rows):
                pairs = swaps(text[off[row] : off[row + 1]], table)
                minus.append([of(t) for t, _ in pairs])
                plus.append([of(o) for _, o in pairs])
            yield batch(
                doc_id=b.column("doc_id"), toxic=b.column("toxic").cast(pa.int32()),
                features=pa.array([feats[at[i] : at[i + 1]] for i in range(b.num_rows)], pa.list_(pa.int32())),
                minus=pa.array(minus, pa.list_(pa.list_(pa.int32()))), plus=pa.array(plus, pa.list_(pa.list_(pa.int32()))),
            )

    got = sampled.mapInArrow(tidied(extract), "doc_id long, toxic int, features array<int>, minus array<array<int>>, plus array<array<int>>").toArrow().combine_chunks().sort_by("doc_id")
    y = got.column("toxic").to_numpy().astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    weights = np.zeros(1 << BITS)
    odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if share in (0.0, 1.0) or not len(y):
        return Model(weights, float(odds))
    lists = got.column("features").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy().astype(np.int64)
    pairs = [(m, p) for ms, ps in zip(got.column("minus").to_pylist(), got.column("plus").to_pylist()) for m, p in zip(ms, ps)]
    minus, plus = (np.array([x[i] for x in pairs], np.int64).reshape(-1, 2) for i in (0, 1))

    # Features that say nothing are dropped from the lists; the others keep their order.
    told = screen(flat, np.repeat(y, np.diff(at)), y) >= least_g
    upto = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(told[flat], out=upto[1:])
    flat, at = flat[told[flat]], upto[at]

    bias, seen, seen_bias = odds, np.full(1 << BITS, 1e-8), 1e-8
    rng = np.random.default_rng(0)
    step = 512
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), step):
            rows = order[lo : lo + step]
            lens = at[rows + 1] - at[rows]
            full = rows[lens > 0]
            lens = lens[lens > 0]
            before = np.cumsum(lens) - lens
            idx = flat[np.arange(lens.sum()) + np.repeat(at[full] - before, lens)]
            z = bias + (np.add.reduceat(weights[idx], before) if len(full) else 0)
            g = (1 / (1 + np.exp(-z)) - y[full]) / step
            grad = np.bincount(idx, weights=np.repeat(g, lens), minlength=1 << BITS) + l2 * weights
            if len(minus):
                # The penalty's gradient, over as many swaps as this batch's share of all.
                change = weights[minus].sum(1) - weights[plus].sum(1)
                push = np.repeat(2 * counterfactual * change / len(y), 2)
                grad += np.bincount(minus.ravel(), push, 1 << BITS) - np.bincount(plus.ravel(), push, 1 << BITS)
            seen += grad * grad
            weights -= rate * grad / np.sqrt(seen)
            gb = g.sum()
            seen_bias += gb * gb
            bias -= rate * gb / np.sqrt(seen_bias)
    if prior is not None and 0 < prior < 1:
        bias += np.log(prior / (1 - prior)) - odds
    return Model(weights, float(bias))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then score (0 to 1) for every row; a null or empty text has the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    fields = {f.name: f for f in docs.select(*keep).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            z = np.full(b.num_rows, bias)
            for lo, hi, data, off in parts(b.column("text"), 2 << 20):
                feats, at = features(data, off)
                rows = np.flatnonzero(np.diff(at))
                if len(rows):
                    z[lo + rows] += np.add.reduceat(weights[feats], at[rows])
            kept = {c: b.column(c) for c in fields}
            yield batch(**kept, score=pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

    schema = with_fields(list(fields.values()), "score double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_per_class: int = 10_000, prior: float = 0.3, **options) -> Model:
    """Samples labelled documents and trains. prior: the share of toxic documents that scores assume; a share above that
    of most corpora means that missing a toxic document counts as worse than doubting a clean one."""
    return train(sample(docs, labels, usable, max_per_class), prior, **options)


def reject(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.7, **options) -> DataFrame:
    """docs, with their own columns, without those that score the threshold or more."""
    model = fit(docs, labels, usable, **options)
    return unwrap(score(wrap(docs), model, ("row",)).where(F.col("score") < threshold))
