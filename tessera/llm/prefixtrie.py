"""A trie of conversation prefixes, as level-order (LOUDS) bitvectors per shard.

Every turn of a rebuilt conversation is a place; the key of a place is 128 bits that stand for all turns up to it. Places
with one key are one node. Nodes fall into tiers by their number of members (up to 4,096, up to 4,096 squared, ...) and
into bands of 4,096 levels. A shard is a piece of the trie that lies within one tier and band; it hangs below a node of a
higher tier or a band further up. So a shard has at most 4,096 nodes a level and 4,096 levels, however many conversations share a
turn, and the heavy upper levels are shards of their own, merged after those below them.

A task takes whole shards, lays their nodes out level by level, builds the LOUDS bitvector and the label arrays, and
sums leaves and saved tokens in reverse order with add.at along the parents that the bitvector gives. Totals of a shard's
top go to the node above by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import mix
from .common import batch, binaries, cut

#: Members of a node of the lowest tier, and levels of a band.
TIER = 4096
BAND = 4096
#: Nodes that a task lays out at once (whole shards, so at least one).
NODES_AT_ONCE = 200_000

_D1, _D2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def numbered(df: DataFrame, group: str, order: list) -> DataFrame:
    """df with `pos`, the place (from 1) of each row within its group in that order. Rows are sorted over all partitions, so a
    group may span many; only the number of rows of each partition reaches the driver."""
    placed = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")
    global_at = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").withColumn("n", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    first = global_at.groupBy(group).agg(F.min("n").alias("first"))
    return global_at.join(first, group).withColumn("pos", F.col("n") - F.col("first") + 1).drop("part", "before", "n", "first", "at")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, turn_hash (16 bytes), size (code points) of every turn of every rebuilt conversation, and a row of depth 0 for each.

    A conversation c is the first crc32(c as text) % 6 turns of conversation c - c % 100, then its own turns after as many."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    named = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named.alias("turn_hash"), F.length(text).cast("long").alias("size")).where("conv_id is not null")
    turns = cut(numbered(turns, "conv_id", [F.col("turn").asc_nulls_first(), "turn_hash"]))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = cut(sizes.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))))
    # At most five turns of at most a hundred conversations each.
    lent = turns.where("pos <= 5").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn_hash", "size")
    from_base = known.select("conv_id", "base", "taken").join(lent, "base").where("depth <= taken").select("conv_id", "depth", "turn_hash", "size")
    own = turns.join(known.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "size")
    tops = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00" * 16)).alias("turn_hash"), F.lit(0).cast("long").alias("size"))
    return from_base.unionByName(own).unionByName(tops)


def _step_keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(conv_id, two numbers a row): what each turn at its depth adds to the key."""
    h = np.frombuffer(b"".join(b.column("turn_hash").to_pylist()), np.uint64).reshape(-1, 2)
    depth = b.column("depth").to_numpy().astype(np.uint64)
    return b.column("conv_id").to_numpy(), np.stack([mix(h[:, 0] ^ mix(depth * _D1)), mix(h[:, 1] + mix(depth * _D2 + np.uint64(1)))], 1)


def _runs(conv: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))


def with_keys(places: DataFrame) -> DataFrame:
    """places with key and parent_key (16 bytes): the running xor of what the turns of a conversation add. Sorted over all partitions; for
    a conversation that spans several, the parts before are added from one number a partition."""
    ordered = cut(places.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        held = np.zeros(2, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            conv, step = _step_keys(b)
            first = int(conv[0]) if first is None else first
            tail = conv == conv[-1]
            own = np.bitwise_xor.reduce(step[tail], 0)
            held = held ^ own if last == int(conv[-1]) else own
            last = int(conv[-1])
        if first is not None:
            yield batch(part=pa.array([TaskContext.get().partitionId()]), first=pa.array([first]), last=pa.array([last]), x=pa.array([held.tobytes()], pa.binary()))

    carried, conv_before, key = {}, None, np.zeros(2, np.uint64)
    for r in sorted(ordered.mapInArrow(edges, "part long, first long, last long, x binary").collect()):
        if conv_before == r.first:
            carried[r.part] = (r.first, key.tobytes())
        own = np.frombuffer(r.x, np.uint64)
        key = key ^ own if conv_before == r.first == r.last else own
        conv_before = r.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_before, held = carried.get(TaskContext.get().partitionId(), (None, bytes(16)))
        held = np.frombuffer(held, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            conv, step = _step_keys(b)
            starts = _runs(conv)
            total = np.bitwise_xor.accumulate(step, 0)
            # What came before a conversation's first row is taken out again; the first one may go on from the last batch.
            off = np.concatenate([np.zeros((1, 2), np.uint64), total[starts[1:] - 1]])
            if conv_before == int(conv[0]):
                off[0] = held
            keys = total ^ np.repeat(off, np.diff([*starts, len(conv)]), 0)
            conv_before, held = int(conv[-1]), keys[-1]
            at = np.arange(len(conv) + 1) * 16
            yield batch(conv_id=b.column("conv_id"), depth=b.column("depth"), size=b.column("size"), key=binaries(keys.tobytes(), at), parent_key=binaries((keys ^ step).tobytes(), at))

    return cut(ordered.mapInArrow(run, "conv_id long, depth long, size long, key binary, parent_key binary"))


def louds(parent: np.ndarray) -> np.ndarray:
    """The level-order bitvector of a forest: for each node in level order, after a virtual one above all tops, a one for each
    child, then a zero. parent: of nodes in level order, children of one node together, in the order of their parents; -1: a top."""
    degree = np.bincount(parent + 1, minlength=len(parent) + 1)
    bits = np.ones(len(parent) + len(degree), bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """Each node's parent by rank and select on the bitvector: the zeros before the node's one, less the virtual node."""
    return np.cumsum(~bits)[bits] - 1


class Forest:
    """Shards in level order. Columns are label arrays; `order` leads from them to the rows they came from."""

    def __init__(self, up: np.ndarray, depth: np.ndarray):
        """up: the row of each row's parent, -1 for tops."""
        rank = np.empty(len(up), np.int64)
        self.levels: list[tuple[int, int]] = []
        below = np.zeros(len(up), np.int64)
        order: list[np.ndarray] = []
        done = 0
        # Tops of a forest may lie at any depth; a node's level counts from its top.
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(depth[by_depth]) != 0, [True]]))
        for rows in (by_depth[a:b] for a, b in zip(bounds[:-1], bounds[1:])):
            inner = rows[up[rows] >= 0]
            below[inner] = below[up[inner]] + 1
        by_level = np.argsort(below, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(below[by_level]) != 0, [True]]))
        for level, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            rows = by_level[a:b]
            if level:
                rows = rows[np.argsort(rank[up[rows]], kind="stable")]
            rank[rows] = np.arange(done, done + len(rows))
            self.levels.append((done, done + len(rows)))
            done += len(rows)
            order.append(rows)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        above = up[self.order]
        self.bits = louds(np.where(above >= 0, rank[above], -1))
        self.parent = parents(self.bits)

    def degree(self) -> np.ndarray:
        """Children of each node: the lengths of the runs of ones."""
        ends = np.flatnonzero(~self.bits)
        return np.diff(ends) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees: level by level from the last, each node is added to its parent."""
        total = values.copy()
        for a, b in reversed(self.levels[1:]):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


_NODE = "conv_id long, depth long, parent_conv_id long, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _build(nodes: DataFrame) -> DataFrame:
    """Rows of whole shards, laid out by task. Each row comes with what shards below have given to it: children, leaves, saved. Tops carry
    parent_key and top = true for the shards above."""

    def lay_out(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).combine_chunks()
        at = {k: i for i, k in enumerate(col("key").to_pylist())}
        f = Forest(np.array([at.get(k, -1) for k in col("parent_key").to_pylist()], np.int64), col("depth").to_numpy())
        o = f.order
        take = lambda c: col(c).to_numpy()[o]
        children = f.degree() + take("given_children")
        leaves = f.rollup(take("given_leaves") + (children == 0))
        saved = f.rollup(take("given_saved") + (take("n_convs") - 1) * take("size"))
        rows = t.select(["conv_id", "depth", "key", "parent_key", "n_convs"]).take(pa.array(o)).combine_chunks().to_batches()[0]
        return batch(**{n: rows.column(n) for n in rows.schema.names}, n_children=pa.array(children), n_leaves=pa.array(leaves), saved_tokens=pa.array(saved), top=pa.array(f.parent < 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < NODES_AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            shard = t.column("shard").combine_chunks()
            # The last shard may go on; all before it are whole.
            same = np.array(shard.to_pylist(), object) == shard[-1].as_py()
            k = int(np.argmax(same))
            if k:
                yield lay_out(t.slice(0, k))
            held, rows = t.slice(k).to_batches(), t.num_rows - k
        if rows:
            yield lay_out(pa.Table.from_batches(held))

    schema = "conv_id long, depth long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
    return nodes.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: of the conversations that end at a node, their ids in ascending order, comma-joined. Ids are sorted over all
    partitions and joined to pieces of up to 1 MB there; a node's pieces are then hashed one after the other."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0
        done: list[tuple] = []

        def flush() -> None:
            nonlocal ids, size
            if ids:
                done.append((key, ids[0], ",".join(map(str, ids))))
            ids, size = [], 0

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if k != key or size > 1 << 20:
                    flush()
                    key = k
                ids.append(c)
                size += len(str(c)) + 1
            if len(done) > 1000:
                yield _pieces(done)
                done = []
        flush()
        if done:
            yield _pieces(done)

    def _pieces(done: list[tuple]) -> pa.RecordBatch:
        k, first, text = zip(*done)
        return batch(key=pa.array(k, pa.binary()), first=pa.array(first, pa.int64()), ids=pa.array(text, pa.string()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield batch(key=pa.array([x for x, _ in out], pa.binary()), ends_sha256=pa.array([x for _, x in out], pa.string()))
        if state:
            yield batch(key=pa.array([key], pa.binary()), ends_sha256=pa.array([state.hexdigest()], pa.string()))

    joined = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, tier: int = TIER, band: int = BAND) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns of equal number by a hash of role and text. Null role or text is empty; a
    repeated row is a turn of its own; rows without conv_id take no part; other columns are ignored. An empty table has no
    node. Nodes are told apart by 128 bits of all their turns.
    """
    places = with_keys(rebuilt(conversations))
    counts = places.groupBy("key").agg(F.count("*").alias("n_convs"))
    # Only nodes above the lowest tier need their tier looked up; there are few, as each has more members than a tier.
    tiers = sum((F.col("n_convs") > float(tier) ** k).cast("int") for k in range(1, max(2, int(np.ceil(63 / np.log2(tier))) + 1)))
    heavy = cut(counts.where(F.col("n_convs") > tier).select("key", tiers.alias("tier")))
    placed = places.join(heavy, "key", "left").select("*", F.struct((-F.expr(f"depth div {band}")).alias("band"), F.coalesce("tier", F.lit(0)).alias("tier")).alias("piece")).drop("tier")
    # Within a conversation the places of one tier and band follow each other; the first of them is the top of their shard.
    top = F.first("key").over(Window.partitionBy("conv_id", "piece").orderBy("depth"))
    members = placed.select("conv_id", "depth", "size", "key", "parent_key", "piece", top.alias("shard"))
    nodes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("depth", "size", "parent_key", "piece", "shard")))
    nodes = cut(nodes)
    pieces = sorted(r.piece for r in nodes.select("piece").distinct().collect())
    given = done = None
    for piece in pieces:
        own = nodes.where((F.col("piece.band") == piece.band) & (F.col("piece.tier") == piece.tier))
        zero = F.lit(0).cast("long")
        if given is None:
            own = own.select("*", *(zero.alias(f"given_{c}") for c in ("children", "leaves", "saved")))
        else:
            sums = given.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(sums, "key", "left").select(*own.columns, *(F.coalesce(c, zero).alias(f"given_{c}") for c in ("children", "leaves", "saved")))
        built = cut(_build(own))
        tops = built.where("top and depth > 0").select("parent_key", "n_leaves", "saved_tokens")
        given = tops if given is None else given.unionByName(tops)
        done = built if done is None else done.unionByName(built)
    if done is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    last = places.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end")).select(F.col("end.key").alias("key"), "conv_id")
    above = done.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    full = done.join(above, "parent_key", "left").join(ends_hashes(last), "key", "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return full.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
