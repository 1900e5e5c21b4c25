"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct word shingles, hashed; its sketch are the k smallest hashes. Documents of equal
sets are one representative. Candidates come from inverted lists of sketch values: two similar documents share at least
t of their values, so they share one among the k - t + 1 rarest of each, and only those are listed. In a list, a few
pivots at a time are compared with the other documents; documents that are already in one component need no
comparison, and lists that lie within one component are closed, so a group of n copies costs about n comparisons. What
is left of the lists goes into the next round, until every pair that a list holds was compared or is in one component.
In the lists, a pair must not differ too much in parity: each set is also kept as 256 bits that say which remainders its
hashes have an odd number of times, and two sets differ in at least as many items as these bits do, so no link can fail.
What is left has to pass the estimate of the union's sketch; then, at the same place, the full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, NON_SPACE, hashes, mix, parts, words
from .common import batch, collect_garbage, cut, release, tidied, unwrap, wrap
from .components import ONE_TASK_EDGES, clusters_in_one_task, components
from .lists import differ, linked

#: Pairs, documents and bytes that a block is made for.
PAIRS_PER_BLOCK, DOCS_PER_BLOCK, BYTES_PER_BLOCK = 2000, 2000, 16 << 20
#: Pairs that a task is started for, at least on average.
PAIRS_PER_TASK = 100
#: Bits of a set's parity, in words of 64.
PARITY_WORDS = 4
#: Ids up to this number are broadcast (8 to 40 bytes each), more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Parts that a cluster's pairs are spread over where large clusters are too many to be broadcast.
SALTS = 64

_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row, the hashes of its distinct word shingles in ascending order."""
    low = LOWER[data]
    starts, ends, at = words(low, off, NON_SPACE)
    word = hashes(low, starts, ends)
    h = np.zeros(len(word), np.uint64)
    if len(word) >= size:
        s = word[: len(word) - size + 1].copy()
        for i in range(1, size):
            s = s * _K + word[i : len(word) - size + 1 + i]
        h[: len(s)] = mix(s)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * _K + word[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n, similarity: float, k: int):
    """How many sketch values a set of n shares at least with any set that is similar enough: exact where all of both
    sets is in the sketches, five standard deviations under the mean where it is not."""
    low = math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity)))
    return F.least(F.ceil(F.lit(similarity) * n), F.lit(max(low, 1)))


def parity(hashed: np.ndarray) -> np.ndarray:
    """For each remainder of 256, whether an odd number of hashes has it, in four words."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount((hashed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, k: int = 64, shingle: int = 5) -> DataFrame:
    """key, doc_id, n (set size), f1, f2 (fingerprint of the set), sketch (the k smallest hashes), parity of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, low, odd = [], [], [], [], []
            for _, _, data, off in parts(b.column("text")):
                for s in shingle_sets(data, off, shingle):
                    n.append(len(s))
                    f1.append(s.sum())
                    f2.append(mix(s ^ _K).sum())
                    low.append(s[:k].view(np.int64))
                    odd.append(parity(s))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield batch(key=b.column("key"), doc_id=b.column("doc_id"), n=pa.array(n, pa.int64()), f1=as_long(f1), f2=as_long(f2), sketch=pa.array(low, pa.list_(pa.int64())), parity=pa.array(odd, pa.list_(pa.int64())))

    schema = "key long, doc_id long, n long, f1 long, f2 long, sketch array<long>, parity array<long>"
    return docs.select("key", "doc_id", "text").mapInArrow(tidied(run), schema)


def inverted_lists(reps: DataFrame, similarity: float, k: int) -> DataFrame:
    """value, doc, n: for each representative its rarest sketch values, as many as no similar one can miss, of those that
    another one has too."""
    listed = reps.select(F.col("rep").alias("doc"), "n", F.explode("sketch").alias("value"))
    shared = listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = listed.join(shared, "value").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    held = F.least(F.col("n"), F.lit(k))
    # Values that no other has are rarest of all and fill the first places.
    places = held - least_shared(F.col("n"), similarity, k) + 1 - (held - F.size("values"))
    return mine.where(places > 0).select("doc", "n", F.explode(F.slice("values", F.lit(1), F.greatest(places, F.lit(1)).cast("int"))).alias("x")).select(F.col("x.value").alias("value"), "doc", "n")


def _clustered(pairs: DataFrame) -> DataFrame:
    """The pairs (pivot < doc) with the cluster of each: pairs that hang together by their documents have one cluster."""
    if pairs.count() <= ONE_TASK_EDGES:
        return cut(clusters_in_one_task(pairs))
    of = components(pairs, "pivot", "doc")
    # The larger end of a pair is never the smallest of its cluster, so it is among the nodes.
    out = cut(pairs.select("pivot", "doc").join(of.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc"))
    release(of)
    return out


def _placed(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs with the blocks of their clusters, which are null if small. A hot cluster's pairs stay where they are, or
    (more large clusters than may be broadcast) are spread over salts."""
    if large.count() <= BROADCAST_IDS:
        return pairs.join(F.broadcast(large), "cluster", "left")
    spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["cluster", "salt"], "left").drop("salt")


def _compare(pairs: DataFrame, values: DataFrame, similar) -> tuple[DataFrame, DataFrame]:
    """The pairs (pivot, doc, cluster) for which similar.holds(pivot's value, doc's value), and a stored frame that they read.

    values: doc, value. A cluster is compared at one place, so each of its documents' values is sent there once. In a cluster
    that is large in pairs, documents or bytes of their values, documents are dealt to blocks by hash and pairs to pairs of
    blocks, and a value is sent to each pair of blocks that has a pair of it; so what one pair of blocks holds does not grow.
    """
    n_pairs = pairs.count()
    few = 2 * n_pairs <= BROADCAST_IDS
    ends = pairs.select("cluster", F.explode(F.array("pivot", "doc")).alias("doc")).distinct()
    # Sizes are made before the join, so that it does not move the values.
    held = (F.broadcast(ends) if few else ends).join(values.select("doc", F.octet_length("value").alias("size")), "doc").groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))
    much = [F.ceil(F.sqrt(F.col("pairs") / PAIRS_PER_BLOCK)), F.ceil(F.col("docs") / DOCS_PER_BLOCK), F.ceil(F.col("bytes") / BYTES_PER_BLOCK)]
    large = pairs.groupBy("cluster").agg(F.count("*").alias("pairs")).join(held, "cluster").select("cluster", F.greatest(*much).alias("blocks")).where("blocks > 1")
    large = cut(large)
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    place = "cluster", "x", "y"
    dealt = _placed(pairs, large).select("cluster", block("pivot").alias("x"), block("doc").alias("y"), "pivot", "doc")
    needed = dealt.select(*place, F.explode(F.array("pivot", "doc")).alias("doc")).distinct()
    # Few of them are broadcast (their number is counted), so that the other values need not move.
    needed = (F.broadcast(needed) if few else needed).join(values, "doc")
    rows = needed.select(*place, F.lit(0).alias("is_pair"), F.col("doc").alias("pivot"), F.lit(None).cast("long").alias("doc"), "value")
    rows = rows.unionByName(dealt.select(*place, F.lit(1).alias("is_pair"), "pivot", "doc"), allowMissingColumns=True)
    rows = rows.repartition(*place).sortWithinPartitions(*place, "is_pair", "pivot", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for i, (cluster, x, y, is_pair, pivot, doc) in enumerate(zip(*(b.column(c).to_pylist() for c in (*place, "is_pair", "pivot", "doc")))):
                if now != (cluster, x, y):
                    now, held = (cluster, x, y), {}
                if not is_pair:
                    held[pivot] = similar.prepare(b.column("value")[i])
                elif pivot in held and doc in held and similar.holds(held[pivot], held[doc]):
                    out.append((pivot, doc, cluster))
            yield batch(**{c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("pivot", "doc", "cluster"))})

    # Few pairs need few tasks: a start of Python costs more than some comparisons. Partitions follow one another, so no more is held at once.
    rows = rows.coalesce(max(1, math.ceil(n_pairs / PAIRS_PER_TASK)))
    return rows.mapInArrow(tidied(run), "pivot long, doc long, cluster long"), large


class BySet:
    """Exact Jaccard similarity of the full sets, 100 * intersection >= percent * union, of pairs that pass the estimate: of the k smallest
    values of both sketches together, how many are in both. A sketch is the head of its set, so only the texts have to meet."""

    def __init__(self, percent: int, shingle: int, k: int):
        self.percent, self.shingle, self.k = percent, shingle, k
        j = percent / 100
        self.slack = 5 * math.sqrt(k * j * (1 - j))

    def prepare(self, value) -> np.ndarray:
        data = np.frombuffer(value.as_buffer() or b"", np.uint8)
        return shingle_sets(data, np.array([0, len(data)]), self.shingle)[0]

    def likely(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = np.concatenate([a[: self.k], b[: self.k]])
        both.sort()
        twice = both[1:] == both[:-1]
        n = len(both) - int(twice.sum())
        m = min(n, self.k)
        if n > self.k:
            first = np.concatenate([[True], ~twice])
            last = both[first][m - 1]
            twice = twice & (both[1:] <= last)
        return int(twice.sum()) >= m * self.percent / 100 - self.slack

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)) or not self.likely(a, b):
            return False
        both = np.concatenate([a, b])
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        return 100 * inter >= self.percent * (len(both) - inter)


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its number of rows, which is counted, allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 64, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), one a row.

    Links: 100 * intersection >= percent * union of the shingle sets. A document of fewer words than a shingle is one
    shingle; one without words, or a null text, is linked with nothing. Rows that repeat a doc_id are one document with
    the links of all its rows. A row without doc_id is linked with nothing and kept, with a null component.
    """
    similarity = percent / 100
    # Rows are known by a hash of id and text, as rows of one id can differ.
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", key)
    full = cut(sketch(rows, k, shingle))
    copies = ["f1", "f2", "n"]
    sketched = cut(full.where("n > 0 and doc_id is not null").groupBy(*copies).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")))
    # The wide frames go as soon as what is needed of them is stored.
    sketches = cut(full.select("doc_id", *copies))
    release(full)
    filled = sketches.where("n > 0 and doc_id is not null")
    words_of = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY_WORDS)]
    facts = sketched.select(F.col("rep").alias("doc"), F.struct("n", *words_of).alias("facts"))
    entries = cut(inverted_lists(sketched, similarity, k).drop("n").join(facts, "doc"))
    ids = cut(entries.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").join(entries, "value").select("doc").distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = cut(rows.where("text is not null").select(F.col("key").alias("doc"), F.encode("text", "UTF-8").alias("value")).join(wanted, "doc", "left_semi").dropDuplicates(["doc"]))
    reps = cut(sketched.select(*copies, "rep", "least"))
    release(sketched)
    collect_garbage(docs.sparkSession)
    stored: list[DataFrame] = []

    def compare(pairs: DataFrame) -> DataFrame:
        release(*stored)  # of the round before
        pairs = _clustered(pairs)
        found, large = _compare(pairs, texts, BySet(percent, shingle, k))
        stored[:] = pairs, large
        return found.select("pivot", "doc")

    def may(x: Column, y: Column) -> Column:
        return differ(x, y, percent, PARITY_WORDS)

    members = linked(entries, compare, may)
    release(*stored, entries, texts, ids)
    # Each set's component goes by its smallest document; sets that are alone are not moved for it.
    joined = members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
    inside = cut(reps.select("rep", "least").join(_few(joined.withColumnRenamed("node", "rep")), "rep"))
    heads = cut(inside.join(_few(inside.groupBy("component").agg(F.min("least").alias("head"))), "component").select("rep", "head"))
    sets = reps.join(_few(heads), "rep", "left").select(*copies, F.coalesce("head", "least").alias("head"))
    own = filled.select("doc_id", *copies).join(sets, copies).select("doc_id", "head")
    # A document whose rows differ is in several sets; its links join them.
    final = cut(own.groupBy("doc_id").agg(F.min("head").alias("component_id"), F.max("head").alias("other")))
    if not final.where("component_id <> other").isEmpty():
        final = components(own, "doc_id", "head").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    release(inside, heads)
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, k: int = 64, shingle: int = 5) -> DataFrame:
    """docs, with their own columns, one document of each component (that of the smallest doc_id)."""
    gone = near_duplicates(docs, percent, k, shingle).where("not kept").select("doc_id").distinct()
    return unwrap(wrap(docs).join(gone, "doc_id", "left_anti"))
