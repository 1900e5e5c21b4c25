"""Connected components of an edge list, by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, release, tidied

#: Edges (two numbers each) of which one task may hold all: some tens of MB.
ONE_TASK_EDGES = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all ends of edges that are not the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        # Roots hook to each other by the edges that are left.
        x, y = x[apart], y[apart]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if rows:
            node, to = joined(*(np.concatenate(x) for x in zip(*rows)))
            yield batch(node=pa.array(node), to=pa.array(to))

    return edges.select("a", "b").coalesce(1).mapInArrow(tidied(run), "node long, to long")


def clusters_in_one_task(pairs: DataFrame) -> DataFrame:
    """The pairs (pivot < doc), at most ONE_TASK_EDGES of them, with the cluster of each: the smallest item that hangs together with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("pivot").to_numpy(), b.column("doc").to_numpy()) for b in batches]
        if rows:
            pivot, doc = (np.concatenate(x) for x in zip(*rows))
            node, to = joined(pivot, doc)
            # The larger end of a pair is never the smallest of its cluster, so it is among the nodes, which ascend.
            yield batch(pivot=pa.array(pivot), doc=pa.array(doc), cluster=pa.array(to[np.searchsorted(node, doc)]))

    return pairs.select("pivot", "doc").coalesce(1).mapInArrow(tidied(run), "pivot long, doc long, cluster long")


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, component (smallest node reachable) for every node that is not itself the smallest of its component.

    Distributed union-find: in a round each node points to its smallest neighbour if that is smaller, pointers are
    doubled until all lead to roots, and edges are drawn anew between the roots of their ends. At least half of the nodes go in a round.
    Rounds are cut by checkpoints; only counts of edges reach the driver. Once at most `one_task` edges are left, one task
    of an executor joins what is left. Null ends, loops and repeated edges count for nothing.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    left = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    rounds: list[DataFrame] = []
    # One task needs no tidy edges, so few of them are not shuffled.
    if left.count() > one_task:
        before, left = left, cut(tidy(left))
        release(before)
    while left.count() > one_task:
        # Every edge (a, b) has b < a, so a node hooks to the least b of the edges in which it is a.
        hook = cut(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")))
        while True:
            onward = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
            if hook.join(onward, "to", "left_semi").isEmpty():
                break
            before, hook = hook, cut(hook.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
            release(before)
        rounds.append(hook)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        before, left = left, cut(tidy(ends))
        release(before)
    last = out = cut(_in_one_task(left))
    release(left)
    for earlier in reversed(rounds):
        onward = out.select(F.col("node").alias("to"), F.col("to").alias("further"))
        out = out.unionByName(earlier.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
    out = out.select("node", F.col("to").alias("component"))
    if rounds:
        out = cut(out)
        release(last, *rounds)
    return out
