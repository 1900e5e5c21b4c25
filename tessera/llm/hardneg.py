"""Hard negatives by bit-sliced integer products.

Components are scaled to integers and taken bit plane by bit plane, the most significant first. After each plane a pair's
score lies in an interval: what is summed so far, and what the planes to come can add at least and at most, which is known
from the sums of the anchor's negative and positive components. A pair whose interval cannot qualify is dropped, so few
pairs meet the last planes: those are gathered one by one, the others are products of matrices.

Anchors come in chunks of bounded bytes, which are broadcast; the rows are read in place, without a shuffle, in blocks against
blocks of anchors. A task keeps the best few of each anchor. Lower bounds from a hashed part of the rows go along, so that
what all tasks together return does not follow their number; no row is left out by them that could be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut

SCALE = 256.0
#: Scaled components beyond this are taken as this, so that sums stay within 64 bits.
LIMIT = 1 << 24
POSITIVES = NEGATIVES = 5
#: Bytes of anchors that are broadcast at once.
CHUNK_BYTES = 16 << 20
ANCHORS, ROWS = 512, 4096
#: Lower bounds come from one row in so many.
SEED_PART = 64
_LEAST = -(1 << 62)


def scaled(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components; short vectors are padded by zeros). A row takes no part if it or a component
    is null or not finite."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    width = int(size[good].max()) if good.any() else 0
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(x)) - np.repeat(ends - size, size)
    kept = good[row]
    out[row[kept], at[kept]] = np.clip(np.floor(SCALE * x[kept]), -LIMIT, LIMIT)
    return np.flatnonzero(good), out[good].astype(np.int64)


def taken(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved on by one where vec_id is divisible by 7), vector: of rows with both ids and labels."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id").cast("long") % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").alias("vector")).where("vec_id is not null and label is not null and vector is not null")


def wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(a: np.ndarray, r: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs with low <= score <= high, the bounds by anchor. With `best`, pairs that are certainly not
    among the best so many of their anchor may go too."""
    width = max(a.shape[1], r.shape[1])
    a, r = wide(a, width), wide(r, width)
    base = min(int(r.min(initial=0)), 0)
    u = r - base
    kind = np.float32 if width * int(np.abs(a).max(initial=0)) < 1 << 24 else np.float64
    af = a.astype(kind)
    up, down = np.maximum(a, 0).sum(1)[:, None], np.minimum(a, 0).sum(1)[:, None]
    low, high = low[:, None].copy(), high[:, None]
    s = np.repeat(base * a.sum(1)[:, None], len(r), 1)
    alive = allowed.copy()
    b = int(u.max(initial=0)).bit_length()
    while b and alive.sum() * 64 > alive.size:
        b -= 1
        s += (af @ ((u >> b) & 1).astype(kind).T).astype(np.int64) << b
        rest = (1 << b) - 1
        least = s + rest * down
        if best and len(r) > best:
            np.maximum(low, -np.partition(np.where(alive, -least, -_LEAST), best - 1, axis=1)[:, best - 1 : best], out=low)
        alive &= (s + rest * up >= low) & (least <= high)
    i, j = np.nonzero(alive)
    s = s[i, j]
    while b and len(i):
        b -= 1
        s = s + (np.einsum("ij,ij->i", a[i], (u[j] >> b) & 1) << b)
        rest = (1 << b) - 1
        kept = (s + rest * up[i, 0] >= low[i, 0]) & (s + rest * down[i, 0] <= high[i, 0])
        i, j, s = i[kept], j[kept], s[kept]
    return i, j, s


class Best:
    """The best `size` entries (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, size: int):
        self.slots, self.size = slots, size
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[place < self.size]
        self.slot, self.score, self.id = slot[place < self.size], score[order], ids[order]

    def bound(self, low: np.ndarray) -> np.ndarray:
        """The score that a further entry of each slot needs at least."""
        out = low.copy()
        if len(self.slot):
            place = np.arange(len(self.slot)) - np.searchsorted(self.slot, self.slot)
            full = place == self.size - 1
            np.maximum.at(out, self.slot[full], self.score[full])
        return out


def _search(rows: DataFrame, chunk, negatives: bool) -> DataFrame:
    """slot, score, id: for positives the best of each anchor (slot: anchor), for negatives of each anchor's positive (slot: POSITIVES * anchor +
    place), over the rows of a task. chunk: a broadcast dict of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chunk.value
        ids, labels, q = c["id"], c["label"], c["q"]
        low, high = c["low"], c["high"]  # by slot
        per = POSITIVES if negatives else 1
        best = Best(len(low), NEGATIVES if negatives else POSITIVES)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                good, r = scaled(part.column("vector"))
                row_id, row_label = part.column("vec_id").to_numpy()[good], part.column("label").to_numpy()[good]
                if not len(good):
                    continue
                bound = best.bound(low)
                for x in range(0, len(ids), ANCHORS):
                    y = min(x + ANCHORS, len(ids))
                    same = labels[x:y, None] == row_label[None, :]
                    if negatives:
                        need, most = bound[x * per : y * per].reshape(-1, per), high[x * per : y * per].reshape(-1, per)
                        need = np.where(need <= most, need, -_LEAST).min(1)
                        i, j, s = products(q[x:y], r, ~same, need, most.max(1))
                        for p in range(per):
                            slot = (x + i) * per + p
                            kept = (s >= bound[slot]) & (s <= high[slot])
                            best.add(slot[kept], s[kept], row_id[j[kept]])
                    else:
                        allowed = same & (ids[x:y, None] != row_id[None, :])
                        # Anchors and rows of one label at a time, so that few pairs of the block stand idle.
                        for label in np.intersect1d(labels[x:y], row_label):
                            ai, rj = np.flatnonzero(labels[x:y] == label), np.flatnonzero(row_label == label)
                            i, j, s = products(q[x:y][ai], r[rj], allowed[np.ix_(ai, rj)], bound[x:y][ai], high[x:y][ai], POSITIVES)
                            best.add(x + ai[i], s, row_id[rj[j]])
        yield batch(slot=pa.array(best.slot), score=pa.array(best.score), id=pa.array(best.id))

    return rows.mapInArrow(run, "slot long, score long, id long")


def _first(found: DataFrame, most: int) -> DataFrame:
    """slot, score, id, place: the best of each slot over all tasks."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _bounds(found: DataFrame, slots: int, most: int) -> np.ndarray:
    """The score of each slot's last place, where all places are taken."""
    t = _first(found, most).where(F.col("place") == most).select("slot", "score").toArrow()
    out = np.full(slots, _LEAST)
    out[t.column("slot").to_numpy()] = t.column("score").to_numpy()
    return out


def mine(embeddings: DataFrame, anchor: Column | None = None, chunk_bytes: int = CHUNK_BYTES, seed_part: int = SEED_PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors (a condition on vec_id; by default, divisible by 100). Rows with a null vec_id, label or vector, or with
    a null or non-finite component, take no part. A repeated row is a row of its own, be it anchor, positive or negative; rows
    that share the anchor's vec_id are not its positives. Vectors of unequal length are padded by zeros; scaled components
    are limited to +-2 ** 24. Ties go by smaller vec_id. Empty tables give no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = taken(embeddings)
    chosen = rows.where(anchor if anchor is not None else F.col("vec_id") % 100 == 0)

    def as_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, q = scaled(b.column("vector"))
            yield batch(id=b.column("vec_id").take(pa.array(good)), label=b.column("label").take(pa.array(good)), q=pa.array([x.tobytes() for x in q.astype("<i4")], pa.binary()))

    anchors = cut(chosen.mapInArrow(as_integers, "id long, label long, q binary").withColumn("n", F.monotonically_increasing_id()))
    held = anchors.agg(F.coalesce(F.sum(F.length("q") + 16), F.lit(0))).first()[0]
    chunks = -(-held // chunk_bytes)
    seeds = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(seed_part)) == 0)
    out = None
    for k in range(chunks):
        t = anchors.where(F.col("n").bitwiseAND((1 << 33) - 1) % chunks == k).select("id", "label", "q").toArrow()
        if not t.num_rows:
            continue
        q = [np.frombuffer(x, "<i4").astype(np.int64) for x in t.column("q").to_pylist()]
        width = max(map(len, q))
        c = {"id": t.column("id").to_numpy(), "label": t.column("label").to_numpy(), "q": np.stack([np.pad(x, (0, width - len(x))) for x in q])}
        n = len(q)
        c |= {"low": np.full(n, _LEAST), "high": np.full(n, -_LEAST)}
        c["low"] = _bounds(_search(seeds, spark.sparkContext.broadcast(c), False), n, POSITIVES)
        positives = _first(_search(rows, spark.sparkContext.broadcast(c), False), POSITIVES).toArrow()
        slot = positives.column("slot").to_numpy() * POSITIVES + positives.column("place").to_numpy() - 1
        score = positives.column("score").to_numpy()
        low, high = np.full(n * POSITIVES, -_LEAST), np.full(n * POSITIVES, _LEAST)
        low[slot], high[slot] = -((-4 * score) // 5), score
        c |= {"low": low, "high": high}
        c["low"] = np.maximum(low, _bounds(_search(seeds, spark.sparkContext.broadcast(c), True), len(low), NEGATIVES))
        negatives = _first(_search(rows, spark.sparkContext.broadcast(c), True), NEGATIVES)
        pairs = pa.table({"slot": slot, "anchor_id": c["id"][slot // POSITIVES], "positive_id": positives.column("id"), "positive_score": score})
        named = negatives.join(F.broadcast(spark.createDataFrame(pairs)), "slot")
        done = cut(named.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
