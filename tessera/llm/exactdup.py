"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted, in partitions by content, and their
places are their integer names. Then adjacent names are paired, distinct pairs are sorted and named in turn, and so on
until each text has one name. Names are given to contents and pairs themselves, so two texts have the same name exactly
when they are equal. Block contents are shuffled once: occurrences carry a 128-bit signature, which is tested to tell all
named blocks apart (if it did not, another seed would be tried, then the run fails and names blocks).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, parts
from .common import batch, cut

BLOCK = 4096
#: Seeds of signatures that are tried.
SEEDS = (0, 1)


def _signature(block: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(block, seed)


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, max(len(text), 1), BLOCK)]


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """A row a document: row (own number), doc_id, text_sha256, signatures of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, sigs = [], []
            for lo, hi, data, off in parts(b.column("text")):
                low = LOWER[data].tobytes()
                for r in range(hi - lo):
                    text = low[off[r] : off[r + 1]]
                    sha.append(hashlib.sha256(text).hexdigest())
                    sigs.append([_signature(x, seed) for x in _blocks(text)])
            yield batch(doc_id=b.column("doc_id"), text_sha256=pa.array(sha, pa.string()), signatures=pa.array(sigs, pa.list_(pa.binary())))

    out = docs.mapInArrow(run, "doc_id long, text_sha256 string, signatures array<binary>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _contents(docs: DataFrame, seed: int) -> DataFrame:
    """signature, block: the blocks of all documents; within a slice of a few MB each is given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in parts(b.column("text")):
                low = LOWER[data].tobytes()
                own = list({x for r in range(hi - lo) for x in _blocks(low[off[r] : off[r + 1]])})
                yield batch(signature=pa.array([_signature(x, seed) for x in own], pa.binary()), block=pa.array(own, pa.binary()))

    return docs.mapInArrow(run, "signature binary, block binary")


def named_texts(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256 (of the normalised text), name: equal for equal normalised texts and only for those."""
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in SEEDS:
        distinct = _contents(rows_in, seed).distinct()
        names = cut(distinct.sortWithinPartitions("block").select("signature", F.monotonically_increasing_id().alias("name")))
        alike = names.groupBy("signature").count().where("count > 1").limit(3).collect()
        if not alike:
            break
    else:
        raise ValueError(f"blocks that differ share a signature with each of {len(SEEDS)} seeds: {[r.signature.hex() for r in alike]}")
    rows = cut(_rows(rows_in, seed))
    listed = rows.select("row", F.size("signatures").alias("n"), F.posexplode("signatures").alias("pos", "signature"))
    now = cut(listed.join(names, "signature").select("row", "n", "pos", "name"))
    done = [now.where("n = 1").select("row", "name")]
    level = 0
    while not (now := now.where("n > 1")).isEmpty():
        level += 1
        even, odd = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = now.groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(even).alias("a"), F.coalesce(F.max(odd), F.lit(-1)).alias("b"))
        # The level is part of a name: names of different levels differ.
        named = cut(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id() + F.lit(level << 57)))
        now = cut(pairs.join(named, ["a", "b"]).select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"))
        done.append(now.where("n = 1").select("row", "name"))
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    return rows.select("row", "doc_id", "text_sha256").join(ends, "row")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256; one row a row.

    Texts are compared after A-Z are lower-cased; null counts as empty. Repeated rows count each in group_size, and all
    rows of the largest doc_id are kept. In a group without any doc_id, keep_id is null and every row is kept. Other
    columns are ignored.
    """
    named = cut(named_texts(docs).select("doc_id", "text_sha256", "name"))
    groups = named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, "name").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
