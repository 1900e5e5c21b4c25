"""A content-addressed store of token ids.

Each document's id stream is cut by a rolling hash over its last 16 ids into chunks; a chunk is named by the digest of its
bytes and stored once. Documents are recipes: lists of digests, in ascending doc_id order, with a Merkle root over them;
each recipe file has a root over its documents, and the manifest one over the files.

Layout of a store (Parquet as container):
  mixed/kind=chunk/    digest (16 bytes, BLAKE2b), payload (the ids, little-endian, 2 or 4 bytes each)
  recipes/             doc_id, start (ids of all documents before it), n_tokens, digests (16 bytes each), lengths, root; file order
             and row order are ascending in doc_id
  manifest/            part, n_rows, start, n_tokens, root; the row with part -1 is the whole store
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import mix
from .common import batch, cut, fresh_path, remove_path
from .encode import encoded, encoder

WINDOW, SHORTEST, LONGEST = 16, 256, 4096
#: A cut is where the low bits of the rolling hash are zero: one in 1,024 places.
CUT_MASK = np.uint64(1023)
_DIGEST = 16

MIXED = "kind string, digest binary, doc_id long, n_tokens long, digests binary, lengths array<int>, payload binary"
RECIPES = "part int, doc_id long, start long, n_tokens long, digests binary, lengths array<int>, root binary"
PARTS = "part int, n_rows long, start long, n_tokens long, root binary"


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place, a hash of the last 16 ids (by doubling: 1, 2, 4, 8, then 16 of them)."""
    h = mix(ids.astype(np.uint64) + np.uint64(0x51ED270B))
    for span in (1, 2, 4, 8):
        s = h.copy()
        s[span:] += h[:-span] << np.uint64(span)
        h = s
    return mix(h)


def chunk_ends(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Each row's chunk ends, as places in ids."""
    places = np.flatnonzero((rolling(ids) & CUT_MASK) == 0) + 1
    first = np.searchsorted(places, at)
    out = []
    for row in range(len(at) - 1):
        begin, stop, ends = int(at[row]), int(at[row + 1]), []
        for p in [*places[first[row] : first[row + 1]].tolist(), stop]:
            while p - begin > LONGEST:
                begin += LONGEST
                ends.append(begin)
            if p == stop or p - begin >= SHORTEST:
                begin = p
                ends.append(p)
        out.append(ends)
    return out


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves: pairs are hashed level by level, an odd one goes up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write(docs: DataFrame, path: str, tokenizer_path: str, width: int = 2) -> None:
    """Encodes every text once and writes a store. width: bytes an id (2 holds vocabularies of up to 65,536 ids).

    A null or empty text is the end id alone. Repeated rows give repeated recipes. Rows with a null doc_id come first.
    Other columns are ignored. The payloads are shuffled once, by digest, after each task has dropped its own repeats, so
    a chunk that much of the corpus shares comes at most once from each task.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen = encoder(tokenizer_path), set()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, ids, at in encoded(by, b.column("text")):
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                raw = memoryview(ids.astype(kind).tobytes())
                rows: list[tuple] = []
                for row, ends in enumerate(chunk_ends(ids, at)):
                    begin, names, lengths = int(at[row]), [], []
                    for end in ends:
                        payload = raw[begin * width : end * width]
                        name = digest(payload)
                        if name not in seen:
                            seen.add(name)
                            rows.append(("chunk", name, None, None, None, None, bytes(payload)))
                        names.append(name)
                        lengths.append(end - begin)
                        begin = end
                    joined = b"".join(names)
                    rows.append(("recipe", None, doc_ids[lo + row], sum(lengths), joined, lengths, None))
                cols = list(zip(*rows))
                types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary())
                yield batch(**{n: pa.array(c, t) for n, c, t in zip(("kind", "digest", "doc_id", "n_tokens", "digests", "lengths", "payload"), cols, types)})

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal digests are in one partition; memory: 16 bytes and some for each of its chunks."""
        seen: set[bytes] = set()
        for b in batches:
            keep = []
            for name in b.column("digest").to_pylist():
                keep.append(name is None or name not in seen)
                if name is not None:
                    seen.add(name)
            yield b.filter(pa.array(keep))

    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(cut_up, MIXED)
    # A hash of null is a number too, so chunks and recipes are told apart by their kind.
    rows = rows.repartition(F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "digests")))
    rows.mapInArrow(once, rows.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/mixed")

    recipes = spark.read.schema(MIXED).parquet(f"{path}/mixed").where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "lengths")
    keys = [F.col("doc_id").asc_nulls_first(), "n_tokens", "digests"]
    ordered = recipes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{path}/ordered")
    ordered = spark.read.schema("doc_id long, n_tokens long, digests binary, lengths array<int>, part int").parquet(f"{path}/ordered")
    # One row a partition: its size is the number of partitions, whatever the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens")).withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    started = ordered.join(F.broadcast(totals), "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rooted = started.select("part", "doc_id", "start", "n_tokens", "digests", "lengths", roots("digests").alias("root"))
    rooted.write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove_path(spark, f"{path}/ordered")
    parts = cut(_part_roots(spark.read.schema(RECIPES).parquet(f"{path}/recipes")))
    _manifest(parts).write.parquet(f"{path}/manifest")


def _manifest(parts: DataFrame) -> DataFrame:
    """The rows of recipe files, and one (part -1) over all of them. There is a row a file, so all of them may meet."""
    listed = F.array_sort(F.collect_list(F.struct("part", "root")))
    whole = parts.groupBy().agg(F.lit(-1).alias("part"), F.sum("n_rows").alias("n_rows"), F.lit(0).cast("long").alias("start"), F.sum("n_tokens").alias("n_tokens"), roots(F.array_join(F.transform(listed, lambda x: F.hex(x["root"])), "")).alias("root"))
    return parts.unionByName(whole)


@F.pandas_udf(T.BinaryType())
def roots(joined: pd.Series) -> pd.Series:
    """Merkle roots over digests that are joined, as bytes or in hexadecimal."""

    def root(x):
        data = bytes.fromhex(x) if isinstance(x, str) else bytes(x)
        return merkle([data[i : i + _DIGEST] for i in range(0, len(data), _DIGEST)])

    return joined.map(root)


class Tree:
    """A Merkle root over leaves as they come: equal subtrees are joined at once, so as many digests are held as the number of leaves has bits. The root is that of `merkle`."""

    def __init__(self):
        self.held: list[tuple[int, bytes]] = []
        self.rows = 0

    def add(self, leaf: bytes) -> None:
        height, name = 0, leaf
        while self.held and self.held[-1][0] == height:
            name = digest(self.held.pop()[1] + name)
            height += 1
        self.held.append((height, name))
        self.rows += 1

    def root(self) -> bytes:
        if not self.held:
            return digest(b"")
        name = self.held[-1][1]
        for _, left in reversed(self.held[:-1]):
            name = digest(left + name)
        return name


def _part_roots(recipes: DataFrame) -> DataFrame:
    """A row a recipe file: its rows, first start, ids, and the Merkle root over its documents in row order; a leaf is of doc_id, start, number of ids and root."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list] = {}
        for b in batches:
            for part, doc_id, start, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "root"))):
                s = trees.setdefault(part, [Tree(), start, 0])
                s[0].add(digest(f"{doc_id},{start},{n},".encode() + (root or b"")))
                s[2] += n or 0
        if trees:
            columns = zip(*((part, t.rows, start, n, t.root()) for part, (t, start, n) in trees.items()))
            yield batch(**{c: pa.array(v, t) for (c, t), v in zip((("part", pa.int32()), ("n_rows", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())), columns)})

    small = recipes.select("part", "doc_id", "start", "n_tokens", "root")
    return small.repartition("part").sortWithinPartitions("part", "start", "doc_id", "n_tokens", "root").mapInArrow(fold, PARTS)


def verified_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, sound for each recipe file: whether its rows are those of the manifest (number, order, starts, roots). No file is sound where the manifest does not agree with
    itself or where one of its files is gone."""
    told = spark.read.schema(PARTS).parquet(f"{path}/manifest")
    own = told.where("part >= 0")
    fields = ("n_rows", "start", "n_tokens", "root")
    same = lambda x, y: reduce(lambda p, q: p & q, (F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in fields))
    again, whole = _manifest(own).where("part = -1").alias("x"), told.where("part = -1").alias("y")
    agrees = again.join(F.broadcast(whole), F.col("x.part") == F.col("y.part"), "left").select(F.coalesce(same("x", "y"), F.lit(False)).alias("agrees"))
    found = _part_roots(spark.read.schema(RECIPES).parquet(f"{path}/recipes")).alias("x")
    met = cut(found.join(F.broadcast(own.alias("y")), F.col("x.part") == F.col("y.part"), "left").select(F.col("x.part").alias("part"), F.coalesce(same("x", "y"), F.lit(False)).alias("sound")))
    # A row a file; whether all are there and the manifest agrees are two facts about the store.
    whole_store = bool(agrees.first().agrees) and own.join(F.broadcast(met), "part", "left_anti").isEmpty()
    return met.withColumn("sound", F.col("sound") & F.lit(whole_store))


def _zeros_table() -> list[np.ndarray]:
    """For each i: four byte tables of the operator that moves a crc32 past 2**i zero bytes."""
    columns = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint32)  # past one zero bit

    def apply(tables, x):
        return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]

    def tabulate(cols):
        t = np.zeros((4, 256), np.uint32)
        v = np.arange(256)
        for byte in range(4):
            for bit in range(8):
                t[byte] ^= np.where(v >> bit & 1, cols[8 * byte + bit], 0).astype(np.uint32)
        return t

    out = []
    for i in range(3 + 40):
        t = tabulate(columns)
        if i >= 3:
            out.append(t)
        columns = apply(t, columns)
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What crc32 values contribute to a crc32 when n_bytes more bytes follow; contributions are joined by xor."""
    x, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for i, t in enumerate(_zeros_table()):
        on = np.flatnonzero(n >> i & 1)
        if len(on):
            y = x[on]
            x[on] = t[0][y & 255] ^ t[1][y >> 8 & 255] ^ t[2][y >> 16 & 255] ^ t[3][y >> 24]
    return x


def read_chunks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """digest, n_ids, ids_crc32 (of the ids as unsigned 32-bit) of every stored chunk; fails where a payload and its name differ."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, crcs, counts = b.column("digest").to_pylist(), [], []
            for name, payload in zip(names, b.column("payload")):
                data = payload.as_buffer()
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                ids = np.frombuffer(data, kind).astype("<u4")
                crcs.append(zlib.crc32(ids))
                counts.append(len(ids))
            yield batch(digest=pa.array(names, pa.binary()), n_ids=pa.array(counts, pa.int64()), ids_crc32=pa.array(crcs, pa.int64()))

    return spark.read.schema(MIXED).parquet(f"{path}/mixed").where("kind = 'chunk'").select("digest", "payload").mapInArrow(verify, "digest binary, n_ids long, ids_crc32 long")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with `intact`: whether the root is that of the digests."""
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes").withColumn("intact", roots("digests") == F.col("root"))


def _references(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document, with the ids of the document that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("lengths")
            counts = np.diff(lengths.offsets.to_numpy())
            flat = lengths.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), counts)
            first = np.cumsum(counts) - counts
            upto = np.cumsum(flat)
            before = (upto - flat)[first] if len(flat) else first
            n_tokens = b.column("n_tokens").to_numpy()
            names = [x[i : i + _DIGEST] for x in b.column("digests").to_pylist() for i in range(0, len(x), _DIGEST)]
            yield batch(
                **{c: b.column(c).take(pa.array(row)) for c in ("doc_id", "start", "n_tokens", "intact")}, i=pa.array((np.arange(len(row)) - first[row]).astype(np.int32)),
                digest=pa.array(names, pa.binary()), n=pa.array(flat), after=pa.array(n_tokens[row] - (upto - before[row])),
            )

    kept = recipes.select("doc_id", "start", "n_tokens", "intact", "digests", "lengths")
    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, intact boolean, i int, digest binary, n long, after long")


def document_checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified (its root, chunk lengths and sum agree, and its recipe file is that of the manifest).

    The crc32 of a document is put together from those of its chunks, so payloads are read once and not shuffled.
    """

    @F.pandas_udf("long")
    def moved(crc: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(shift_crc(crc.to_numpy(), n.to_numpy()).astype(np.int64))

    sound = F.broadcast(verified_parts(spark, path))
    recipes = read_recipes(spark, path).join(sound, "part", "left").withColumn("intact", F.coalesce(F.col("intact") & F.col("sound"), F.lit(False)))
    refs = _references(recipes).join(read_chunks(spark, path, width), "digest", "left")
    shifted = refs.withColumn("share", moved(F.coalesce("ids_crc32", F.lit(0)), F.col("after") * 4))
    fits = F.coalesce(F.col("n_ids") == F.col("n"), F.lit(False)) & F.col("intact")
    # A repeated row has the same doc_id but a start of its own.
    grouped = shifted.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"), F.min(fits).alias("fits"), F.sum("n").alias("n"))
    return grouped.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("fits") & (F.col("n") == F.col("n_tokens"))).alias("verified"))


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start and ids of every document, put together from its chunks."""
    kind = {2: "<u2", 4: "<u4"}[width]

    @F.pandas_udf("array<int>")
    def decode(payload: pd.Series) -> pd.Series:
        return payload.map(lambda x: np.frombuffer(x, kind).astype(np.int32))

    chunks = spark.read.schema(MIXED).parquet(f"{path}/mixed").where("kind = 'chunk'").select("digest", "payload")
    refs = _references(read_recipes(spark, path)).join(chunks, "digest")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"]))
    return refs.withColumn("ids", decode("payload")).groupBy("doc_id", "start").agg(ids.alias("ids"))


def new_store(docs: DataFrame, tokenizer_path: str, width: int = 2) -> str:
    """Writes a store into the shared folder; returns its path."""
    path = fresh_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer_path, width)
    return path
