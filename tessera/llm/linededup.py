"""Fuzzy line dedup by MinHash.

A line is named by two 64-bit hashes. Its signature comes from one hash of all its character 5-shingles: from each of some
places of the hash range, the next few hashes (in a circle) make a band, so two lines share a band with a power of their
similarity, however short they are. Lines of few shingles have bands of four, others of six, as long lines resemble each
other more by chance; sizes that links can cross have both. Lines of one band are candidates; so are lines of few
shingles whose sets are equal, or are with one shingle less, which misses no link among them. Their full sets of shingles
decide. Linked lines are one component, of which the first line of the corpus stays.

Signatures and sets are made in Arrow batches with numpy; all else are DataFrame functions. A form in DataFrame functions
alone takes several times the processor time (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import mix, parts, ranges
from .charsets import NAME_BITS, sets, similar
from .common import batch, collect_garbage, cut, fresh_path, release, remove_path, tidied, unwrap, wrap
from .lists import differ, linked

#: Bands, and hashes of a band, for sets of up to SHORT shingles and for larger ones. Of links at 80 % they miss 0.1 % and 0.8 %.
SHORT, SHORT_BANDS, LONG_BANDS = 128, (14, 4), (16, 6)
#: Bits of a set's parity, in words of 64.
PARITY_WORDS = 8
#: Tables of up to this many rows (of a few numbers each) are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Bytes of lines that are signed or compared at a time; a longer line is taken alone.
CHUNK = 1 << 18
#: Bytes of text whose lines are told apart at a time.
SLICE = 1 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
#: The seed under which a hash of 1, then a line, goes on.
_SEED = 42


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, h1, h2 for each line that is not blank."""
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return listed.where(F.col("line").rlike(r"\S")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def covered(percent: int) -> int:
    """Up to this set size, linked sets are equal, or are with one shingle less of either or both: they differ in two
    shingles at most, and not by two in size."""
    return min(199 // max(100 - percent, 1), 16)


def _bands(lines: np.ndarray, key: np.ndarray, name: np.ndarray, first: np.ndarray, bits: int, bands: int, rows: int) -> np.ndarray:
    """The band values of the given lines, from their sorted sets."""
    n, start = np.diff(first)[lines][:, None], first[lines][:, None]
    places = np.array([j * ((1 << bits) // bands) for j in range(bands)], np.uint64)
    rel = np.searchsorted(key, ((lines.astype(np.uint64)[:, None] << np.uint64(bits)) | places).ravel()).reshape(-1, bands) - start
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(rows << 32), rel.shape) * _K
    for r in range(rows):
        out = mix(out * _K + name[start + (rel + r) % n])
    return out.view(np.int64)


def signed(data: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For each line: the size of its set, the values under which it is listed, and its set's parity."""
    key, first, bits = sets(data, at)
    n = np.diff(first)
    name = (key & np.uint64((1 << bits) - 1)) >> np.uint64(bits - NAME_BITS)
    bit, word = np.uint64(1) << (name & np.uint64(63)), (name >> np.uint64(6)) % np.uint64(PARITY_WORDS)
    parity = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), first[:-1]) for w in range(PARITY_WORDS)], 1).view(np.int64)
    few = covered(percent)
    # Links join sizes of at least percent : 100, so both ends of a link have bands of one kind.
    kinds = ((np.flatnonzero(n <= SHORT), SHORT_BANDS), (np.flatnonzero(100 * n >= percent * SHORT), LONG_BANDS))
    values = [np.zeros(0, np.int64)] * len(n)
    for lines, (bands, rows) in kinds:
        for i, own in zip(lines.tolist(), _bands(lines, key, name, first, bits, bands, rows)):
            values[i] = np.concatenate([values[i], own]) if len(values[i]) else own
    for i in np.flatnonzero(n <= few).tolist():
        # The exclusive or names a set; without one shingle it is that of the rest.
        own = mix(name[first[i] : first[i + 1]])
        whole = np.bitwise_xor.reduce(own)
        rests = own ^ whole if 100 * (n[i] - 1) >= percent * n[i] else own[:0]
        named = mix(np.append(rests, whole) ^ _K).view(np.int64)
        # Sets whose links are all covered have no bands.
        values[i] = np.unique(np.concatenate([named, values[i]]) if 100 * n[i] >= percent * (few + 1) else named)
    return n, values, parity


def split_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and numbers within their rows of all lines that are not blank."""
    feeds = np.flatnonzero(data == 0x0A)
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feeds, "right") - 1])
    order = np.argsort(row, kind="stable")
    starts, row = np.concatenate([off[:-1], feeds + 1])[order], row[order]
    last = np.append(row[1:] != row[:-1], True)
    ends = np.where(last, off[row + 1], np.append(starts[1:], 0) - 1)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    blank = data == 0x20
    blank |= data - np.uint8(0x09) <= 4
    upto = np.zeros(len(data) + 1, np.int32)
    np.cumsum(blank, out=upto[1:])
    full = upto[ends] - upto[starts] < ends - starts
    return starts[full], ends[full], row[full], number[full]


def _chunks(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about CHUNK bytes each."""
    upto = np.concatenate([[0], np.cumsum(lens)])
    lo = 0
    while lo < len(lens):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """A row for each distinct line of some MB of text: h1, h2, n_rows (occurrences), first_doc and first_line (the first of
    them); and, once a task, n (set size), p0 to p7 (parity) and values (otherwise null). Memory: 16 bytes and some for
    each distinct line of a task."""
    marks = ("n", *(f"p{i}" for i in range(PARITY_WORDS)))
    columns = {"h1": "long", "h2": "long", "n_rows": "long", "first_doc": "long", "first_line": "int", **dict.fromkeys(marks, "long"), "values": "array<long>"}
    seed = docs.sparkSession.range(1).select(F.xxhash64(F.lit(1))).first()[0] % (1 << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[tuple[int, int]] = set()
        for b in batches:
            ids = b.column("doc_id")
            known = np.asarray(ids.is_valid())
            doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in parts(b.column("text"), SLICE):
                starts, ends, row, line_no = split_lines(data, off)
                if not len(starts):
                    continue
                raw = memoryview(data.tobytes())
                pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
                h = np.array([(xxhash.xxh64_intdigest(x, _SEED), xxhash.xxh64_intdigest(x, seed)) for x in pieces], np.uint64).view(np.int64)
                # The first occurrence of each line: rows without doc_id come first.
                order = np.lexsort((line_no, doc_ids[lo + row], known[lo + row], h[:, 1], h[:, 0]))
                new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]).any(1)])
                where = np.flatnonzero(new)
                pick, count = order[where], np.diff(np.append(where, len(order)))
                fresh = np.array([x not in seen for x in map(tuple, h[pick].tolist())])
                seen.update(map(tuple, h[pick[fresh]].tolist()))
                lens = (ends - starts)[pick]
                for own, times, again in [(pick[~fresh], count[~fresh], True)] + [(pick[fresh][a:z], count[fresh][a:z], False) for a, z in _chunks(lens[fresh])]:
                    place = lo + row[own]
                    said = {"h1": h[own, 0], "h2": h[own, 1], "n_rows": times.astype(np.int64), "first_line": line_no[own].astype(np.int32)}
                    out = {"first_doc": pa.array(doc_ids[place].astype(np.int64), mask=~known[place])} | {k: pa.array(v) for k, v in said.items()}
                    if again:
                        out |= {c: pa.nulls(len(own), pa.int64()) for c in marks} | {"values": pa.nulls(len(own), pa.list_(pa.int64()))}
                    else:
                        size = (ends - starts)[own]
                        n, values, parity = signed(data[ranges(starts[own], size)], np.concatenate([[0], np.cumsum(size)]), percent)
                        out |= {"n": pa.array(n.astype(np.int64)), "values": pa.array(values, pa.list_(pa.int64()))} | {f"p{i}": pa.array(parity[:, i]) for i in range(PARITY_WORDS)}
                    yield batch(**{c: out[c] for c in columns})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def _meeting(listed: DataFrame) -> DataFrame:
    """The distinct (value, doc) of values with two docs and more. Hot values come in order, so no list is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, paired = np.zeros((0, 2), np.int64), False  # the row before, and whether it has a partner already
        for b in batches:
            rows = np.concatenate([last, np.stack([b.column(c).to_numpy() for c in ("value", "doc")], 1)])
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
            same = rows[1:, 0] == rows[:-1, 0]
            kept = np.concatenate([[paired], same]) | np.concatenate([same, [False]])
            # The first row has been given out if it had a partner, the last one is when it gets one.
            kept[0] &= not paired
            yield batch(value=pa.array(rows[kept, 0]), doc=pa.array(rows[kept, 1]))
            last, paired = rows[-1:], bool(kept[-1]) or (len(rows) == 1 and paired)

    return listed.repartition("value").sortWithinPartitions("value", "doc").mapInArrow(tidied(run), "value long, doc long")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its number of rows, which is counted, allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (pivot, doc, a_line, b_line) those whose lines are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (b.column(c).cast(pa.binary()) for c in ("a_line", "b_line"))
            lens = np.stack([np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]) for x in (a, z)], 1).astype(np.int64)
            good = np.zeros(b.num_rows, bool)
            for lo, hi in _chunks(lens.sum(1)):
                text = b"".join(x for two in zip(a[lo:hi].to_pylist(), z[lo:hi].to_pylist()) for x in two)
                good[lo:hi] = similar(np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(lens[lo:hi].ravel())]), percent)
            yield b.select(["pivot", "doc"]).filter(pa.array(good))

    return pairs.select("pivot", "doc", "a_line", "b_line").mapInArrow(tidied(run), "pivot long, doc long")


def duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, dropped (array of line_no, h1): the lines of each document that another one of their component stands for.

    Lines are equal, or linked where 100 * intersection >= percent * union of their character 5-shingles (a shorter line
    is one shingle). Of a component, the first line stays: smallest doc_id, then line_no; rows without doc_id come first
    and lose nothing. Blank lines are never dropped. Rows that repeat a doc_id are one document: equal lines at equal
    places are one line. Candidates share a band, or are found for certain where both have few shingles; see the README for measured recall.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    made = signatures(docs, percent)
    made.write.option("parquet.enable.dictionary", "false").parquet(path)
    table = spark.read.schema(made.schema).parquet(path)
    names = table.groupBy("h1").agg(F.min("h2").alias("h2"), F.max("h2").alias("other"), F.sum("n_rows").alias("n_rows"))
    often = cut(names.where("n_rows > 1"))
    # Lines whose first hash has two second ones take part as exact lines only.
    unclear = often.where("h2 <> other").select("h1")
    some_unclear = not unclear.isEmpty()
    listed = table.select(F.explode("values").alias("value"), F.col("h1").alias("doc"))
    if some_unclear:
        listed = listed.join(unclear.select(F.col("h1").alias("doc")), "doc", "left_anti")
    listed = cut(_meeting(listed))
    # The shuffles of all names and of all values go before those of the marks come.
    del names
    collect_garbage(spark)
    ids = cut(listed.select(F.col("doc").alias("h1")).distinct())
    wanted = _few(ids)
    marks = ["n", *(f"p{i}" for i in range(PARITY_WORDS))]
    facts = cut(table.where("n is not null").join(wanted, "h1", "left_semi").groupBy(F.col("h1").alias("doc")).agg(*(F.min(c).alias(c) for c in marks)))
    # The values and the marks of all lines go before the lines that met are fetched.
    wide, path = path, fresh_path(spark, "lines")
    occurrences = table.select("h1", "h2", "n_rows", "first_doc", "first_line")
    occurrences.write.option("parquet.enable.dictionary", "false").parquet(path)
    table = spark.read.schema(occurrences.schema).parquet(path)
    del occurrences
    collect_garbage(spark)
    remove_path(spark, wide)
    texts = cut(_lines(docs).join(wanted, "h1", "left_semi").groupBy("h1").agg(F.first("line").alias("line")))
    entries = listed.join(facts.select("doc", F.struct(*marks).alias("facts")), "doc")

    def compare(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("h1").alias(end), F.col("line").alias(line)) for end, line in (("pivot", "a_line"), ("doc", "b_line")))
        return _verified(pairs.join(b, "doc").join(a, "pivot"), percent)

    def may(x: Column, y: Column) -> Column:
        return differ(x, y, percent, PARITY_WORDS)

    members = linked(entries, compare, may, widen=6)
    release(texts, facts, listed, ids)
    # What stays of each component, and of each line outside of them that occurs more than once.
    heads = members.select(F.col("component").alias("h1"), "component").distinct()
    fuzzy = members.select(F.col("node").alias("h1"), "component").unionByName(heads)
    several = cut(often.select("h1").join(fuzzy, "h1", "full"))
    first = table.join(_few(several), "h1").groupBy("h1", "h2", "component").agg(F.sum("n_rows").alias("n_rows"), F.min(F.struct("first_doc", "first_line")).alias("first"))
    within = first.where("component is not null")
    kept = within.groupBy("component").agg(F.min("first").alias("stays"))
    stay = within.join(kept, "component").select("h1", "h2", "stays")
    stay = cut(stay.unionByName(first.where("component is null and n_rows > 1").select("h1", "h2", F.col("first").alias("stays"))))
    release(several, often)
    remove_path(spark, path)
    lines = _lines(docs).where("doc_id is not null").select("doc_id", "line_no", "h1", "h2")
    gone = lines.join(_few(stay), ["h1", "h2"]).where("not (doc_id <=> stays.first_doc and line_no = stays.first_line)")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "h1"))).alias("dropped"))


def report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (not blank), n_dropped, dropped_lines (line numbers from 0, ascending); one row a row. A null text
    has no lines; a row without doc_id loses none."""
    count = F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))), F.lit(0))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(count).alias("n_lines"))
    out = counted.join(duplicate_lines(docs, percent), "doc_id", "left")
    numbers = F.array_distinct(F.transform(F.coalesce("dropped", F.array()), lambda x: x["line_no"]))
    return out.select("doc_id", "n_lines", F.size(numbers).alias("n_dropped"), numbers.alias("dropped_lines"))


def remove(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without their dropped lines, with their own columns. Documents that lose all their lines go; those that had
    none stay."""
    # Lines are known by place and hash as texts, so that the dropped ones are taken away by a set, in linear time.
    lines = F.split("text", "\n", -1)
    names = F.transform(lines, lambda x, i: F.concat_ws(":", i.cast("string"), F.xxhash64(x).cast("string")))
    gone = F.transform("dropped", lambda d: F.concat_ws(":", d["line_no"].cast("string"), d["h1"].cast("string")))
    left = F.transform(F.array_except(names, gone), lambda k: F.get(lines, F.substring_index(k, ":", 1).cast("int")))
    joined = wrap(docs).join(duplicate_lines(docs, percent), "doc_id", "left")
    cleaned = joined.withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return unwrap(cleaned.where(F.col("dropped").isNull() | F.col("text").rlike(r"\S")), F.col("text"))
