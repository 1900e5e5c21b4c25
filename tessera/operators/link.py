"""Linking of citations to a benchmark of papers by fuzzy keys, year and (as a check) DOI."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise
from ..functions.similarity import lcs_of_pairs, sorted_tokens

METHODS = ("fuzzy_composite", "fuzzy_title_only")


def split(citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, low confidence, not academic). A null confidence isn't low."""
    academic = F.coalesce(normalise.flag(F.col("is_academic")), F.lit(False))
    low = F.col("confidence").eqNullSafe("low") if "confidence" in citations.columns else F.lit(False)
    return citations.where(academic & ~low), citations.where(academic & low), citations.where(~academic)


def document_dois(citations: DataFrame) -> DataFrame:
    """doc_id, dois: the set of each document's first row, also if that is empty."""
    first = citations.groupBy("doc_id").agg(F.min_by(F.struct("doi_candidates"), "row_id").alias("f"))
    return first.select("doc_id", normalise.doi_set(F.col("f.doi_candidates")).alias("dois"))


def benchmark_keys(bench: DataFrame) -> DataFrame:
    """bench_row, key_title, key_composite, doi_norm beside the benchmark's own columns."""
    names = F.from_json("author_lastnames", "array<string>")
    first = F.coalesce(normalise.title(F.get(names, F.lit(0))), F.lit(""))
    t = normalise.title(F.col("title"))
    both = F.when((t != "") & (first != ""), F.concat_ws(" ", t, first)).otherwise(t)
    return bench.withColumns({"key_title": t, "key_composite": both, "doi_norm": normalise.doi(F.col("doi"))})


def citation_keys(citations: DataFrame) -> DataFrame:
    t, a = F.col("recovered_title"), F.col("recovered_authors")
    return citations.withColumns({"key_title": normalise.title(t), "key_author": normalise.first_author(a), "key_composite": normalise.composite_key(t, a)})


def year_ok(a: Column, b: Column, window: int = 2) -> Column:
    """Both known and near."""
    return F.coalesce(F.abs(a - b) <= window, F.lit(False))


#: Keys that a part of a side holds at most (in the mean), and at least if a side is cut into no more than FEW parts; every two parts are one group of the
#: comparison.
PART, LEAST, FEW = 131072, 1024, 8
#: Characters that are counted apart (the last stands for all others), up to how many of each, and how many of these counts' steps become bits.
LETTERS, STEPS, WIDTH = 32, 15, 128
#: Keys of a cell of the left side, keys of the right one that are laid beside them at once, and rows of those that are.
LEAF, TILE, ROWS = 1024, 4096, 16
#: Bits that a key's pairs of characters are hashed to, keys whose pairs are hashed at once, and pairs of keys whose bits are laid side by side at once.
BITS, HASHED, AT_ONCE = 1024, 4096, 1 << 14
#: Pairs of keys that wait to be scored at most, but for those of a tile, and pairs that are kept before the best of each key are taken.
WAITING, KEPT = 1 << 18, 1 << 22
#: Pairs of small groups that a block holds in the mean.
PAIRS = 1 << 22


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all keys, and the place of the key of each."""
    return np.frombuffer("".join(keys).encode("utf-32-le"), "<u4"), np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def _pair_bits(keys: list[str]) -> np.ndarray:
    """For each key which of BITS bits its pairs of neighbouring characters set; the n-th occurrence of a pair counts as a pair of its own."""
    out = np.zeros((len(keys), BITS // 64), np.uint64)
    for k in range(0, len(keys), HASHED):
        x, row = _codes(keys[k : k + HASHED])
        x = x.astype(np.uint64)
        # Sorted by key and then pair, both in one number.
        both = np.sort((row[1:].astype(np.uint64) << np.uint64(42) | x[:-1] << np.uint64(21) | x[1:])[row[1:] == row[:-1]])
        row, pair = (both >> np.uint64(42)).astype(np.int64), both & np.uint64((1 << 42) - 1)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        slot = (((pair << np.uint64(8)) + place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % BITS
        bits = np.zeros((len(keys[k : k + HASHED]), BITS), bool)
        bits[row, slot] = True
        out[k : k + HASHED] = np.packbits(bits, 1).view(np.uint64)
    return out


def _letter_counts(*sides: list[str]) -> list[np.ndarray]:
    """For each key of each side how often it has each of the most frequent characters, and all others together; up to 255 of each."""
    every = [np.zeros(0, np.int64)]
    for k in (side[i : i + HASHED] for side in sides for i in range(0, len(side), HASHED)):
        n = np.bincount(_codes(k)[0])
        every[0], n = (every[0], n) if len(every[0]) >= len(n) else (n, every[0])
        every[0][: len(n)] += n
    place = np.full(len(every[0]), LETTERS - 1)
    often = np.argsort(-every[0], kind="stable")[: LETTERS - 1]
    place[often] = np.arange(len(often))
    out = [np.zeros((len(side), LETTERS), np.uint8) for side in sides]
    for side, counts in zip(sides, out):
        for i in range(0, len(side), HASHED):
            x, row = _codes(side[i : i + HASHED])
            n = np.bincount(row * LETTERS + place[x], minlength=len(side[i : i + HASHED]) * LETTERS)
            counts[i : i + HASHED] = np.minimum(n, 255).reshape(-1, LETTERS)
    return out


def _signs(x: np.ndarray) -> np.ndarray:
    """Signs of the letters by which sums of counts spread far."""
    around = np.cov(x.T)
    w = np.where(np.linalg.eigh(around)[1][:, -1] < 0, -1.0, 1.0)
    for _ in range(8):
        w = np.where(around @ w < 0, -1.0, 1.0)
    return w.astype(np.float32)


def _cells(counts: list[np.ndarray], lengths: list[np.ndarray], apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all left keys cell by cell, and of the right keys, by length, that can be similar to one of the cell's."""
    x, y = (c.astype(np.float32) for c in counts)
    waiting = [(np.arange(len(x)), np.argsort(lengths[1], kind="stable"))]
    while waiting:
        i, j = waiting.pop()
        if len(i) <= LEAF or not len(j):
            yield i, j
            continue
        w = _signs(x[i[:: -(-len(i) // 2048)]])
        f, g = x[i] @ w, y[j] @ w
        for half in np.array_split(np.argsort(f, kind="stable"), 2):
            # A character that one key leaves out changes its sum by one.
            far = apart * (lengths[1][j] + lengths[0][i[half]].max()) + 1e-3
            waiting.append((i[half], j[(g >= f[half[0]] - far) & (g <= f[half[-1]] + far)]))


def _steps(counts: np.ndarray, letters: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Bits that tell whether a key has at least so many of a letter, in words."""
    return np.packbits(counts.take(letters, 1) >= least, 1).view(np.uint64).T.copy()


def _near_letters(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y, tile by tile, of pairs whose counts of letters differ by no more than the lengths allow. The steps of counts that part most pairs of
    these keys are taken as bits, of which no more can differ than counts do. ly ascends."""
    share = lambda c: (c[:, :, None] >= np.arange(1, STEPS + 1, dtype=np.uint8)).mean(0).ravel()
    p, q = share(x[:: -(-len(x) // 512)]), share(y[:: -(-len(y) // 512)])
    best = np.argsort(-(p * (1 - q) + q * (1 - p)), kind="stable")[:WIDTH]
    letters, least = best // STEPS, (best % STEPS + 1).astype(np.uint8)
    mine = _steps(x, letters, least)
    words, one = np.empty(ROWS * TILE, np.uint64), np.empty(ROWS * TILE, np.uint8)
    # How many bits of a pair differ, and whether no more than may; eight pairs of a word are looked at together, as nearly all are apart.
    apart_by, near = np.empty(len(x) * TILE, np.uint8), np.zeros(len(x) * TILE + 8, bool)
    for k in range(0, len(y), TILE):
        other = _steps(y[k : k + TILE], letters, least)
        size, longest = other.shape[1], ly[min(k + TILE, len(y)) - 1]
        n, fits = (c[: len(x) * size].reshape(-1, size) for c in (apart_by, near))
        for r in range(0, len(x), ROWS):
            sums = n[r : r + ROWS]
            v, more = (c[: sums.size].reshape(sums.shape) for c in (words, one))
            for at, (a, b) in enumerate(zip(mine[:, r : r + ROWS], other)):
                np.bitwise_count(np.bitwise_xor(a[:, None], b, out=v), out=more if at else sums)
                if at:
                    np.add(sums, more, out=sums)
        np.less_equal(n, np.minimum(np.floor(apart * (lx + longest) + 1e-6), 255).astype(np.uint8)[:, None], out=fits)
        near[n.size : n.size + 8] = False
        eights = near[: -(-n.size // 8) * 8].reshape(-1, 8)
        some = np.flatnonzero(eights.view(np.uint64))
        which, at = np.nonzero(eights[some])
        places = some[which] * 8 + at
        i, j = np.divmod(places, size)
        fit = apart_by[places] <= apart * (lx[i] + ly[k + j]) + 1e-6
        yield i[fit], k + j[fit]


def _absent(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i how many bits of x[m[i]] are not in y[n[i]], and the other way round."""
    out = np.empty((2, len(m)), np.int64)
    for k in range(0, len(m), AT_ONCE):
        at = slice(k, k + AT_ONCE)
        a, b = x[m[at]], y[n[at]]
        both = a & b
        out[0, at], out[1, at] = (np.bitwise_count(side ^ both).sum(1, dtype=np.int64) for side in (a, b))
    return out[0], out[1]


def similar_pairs(left: list[str], right: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, scores) of the pairs whose Indel similarity is at least the threshold, some at a time.

    Keys of lengths a and b with a common subsequence of n characters differ by at most a + b - 2 n in their counts of letters, and so do sums of these counts
    with any signs. Keys of the left side are halved by such sums until a cell has few, and only right keys within reach of both ends go with a half. A pair has at
    least 3 n - 1 - (a + b) pairs of neighbours in common, as each character that it leaves out parts at most one pair of neighbours of the subsequence. Bits that
    only one key has are never more than its other pairs, so no pair is missed."""
    if not left or not right:
        return
    apart = 1 - threshold / 100
    lengths = [np.array([len(k) for k in side], np.int64) for side in (left, right)]
    counts, bits = _letter_counts(left, right), [_pair_bits(side) for side in (left, right)]

    def scored(waiting):
        m, n = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(m, kind="stable")
        (a, m), (b, n) = (np.unique(x[order], return_inverse=True) for x in (m, n))
        score = 200.0 * lcs_of_pairs([left[k] for k in a], [right[k] for k in b], m, n) / (lengths[0][a[m]] + lengths[1][b[n]])
        good = score >= threshold
        return a[m[good]], b[n[good]], score[good]

    for i, j in _cells(counts, lengths, apart):
        waiting, size = [], 0
        for m, n in _near_letters(counts[0][i], counts[1][j], lengths[0][i], lengths[1][j], apart) if len(j) else ():
            m, n = i[m], j[n]
            la, lb = lengths[0][m], lengths[1][n]
            fit = 200 * np.minimum(la, lb) >= threshold * (la + lb)
            m, n, la, lb = m[fit], n[fit], la[fit], lb[fit]
            free = la + lb - np.ceil(3 * threshold / 200 * (la + lb) - 1e-6)
            one, other = _absent(*bits, m, n)
            fit = (la + free >= one) & (lb + free >= other)
            waiting, size = [*waiting, (m[fit], n[fit])], size + np.count_nonzero(fit)
            if size >= WAITING:
                yield scored(waiting)
                waiting, size = [], 0
        if size:
            yield scored(waiting)


def _best(found: list, ids: list[np.ndarray], top: int | None) -> list:
    """One part of the found pairs: of each left key the `top` most similar, the smaller right id first among equals."""
    m, n, score = (np.concatenate(x) for x in zip(*found))
    if top is not None:
        order = np.lexsort((ids[1][n], -score, m))
        m, n, score = m[order], n[order], score[order]
        first = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, np.int64)
        keep = np.arange(len(m)) - np.repeat(first, np.diff(np.append(first, len(m)))) < top
        m, n, score = m[keep], n[keep], score[keep]
    return [(m, n, score)]


def similar(left: DataFrame, right: DataFrame, threshold: float, top: int | None = None) -> DataFrame:
    """left_id, right_id, score of all pairs whose keys have an Indel similarity of at least the threshold.

    left, right: id (a whole number), key (not empty). No pair is missed. Each side is cut into parts by its number of keys, and every two parts meet in a
    group of their own, so the work is that of all pairs, but of a nanosecond or two each, while what is held is a part of each side and one tile.
    With `top`, pairs are left out that cannot be among so many of a left key, the more similar and then the smaller right_id first.
    """
    t = float(threshold)
    parts = [max(-(-n // PART), min(FEW, -(-n // LEAST)), 1) for n in (left.count(), right.count())]
    tasks = max(1, min(2 * parts[0] * parts[1], 1024))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = [x.column("id").to_numpy() for x in (a, b)]
        found, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for one in similar_pairs(a.column("key").to_pylist(), b.column("key").to_pylist(), t):
            found, size = [*found, one], size + len(one[0])
            if top is not None and size >= KEPT:
                found, size = _best(found, ids, top), 0
        m, n, score = _best(found, ids, top)[0]
        return pa.table({"left_id": ids[0][m], "right_id": ids[1][n], "score": score})

    def of(d: DataFrame, own: int, other: int, block) -> DataFrame:
        # Numbers of their own seeds, as ids may have been dealt out by their hash before.
        part = F.pmod(F.hash(F.lit(7), "id"), F.lit(own))
        every = F.sequence(F.lit(0), F.lit(other - 1))
        return d.select(F.explode(F.transform(every, lambda i: block(part, i))).alias("block"), F.col("id").cast("long").alias("id"), "key").repartition(tasks, "block")

    sides = [of(left, *parts, lambda x, i: x * parts[1] + i), of(right, *parts[::-1], lambda x, i: i * parts[1] + x)]
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("block")).applyInArrow(compare, "left_id long, right_id long, score double")


def similar_within(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The same for pairs of one group only. left, right: by, id, key. The work is that of the pairs within groups. Groups with up to PART keys a side are
    dealt out whole, many to a block; each side of a larger one is cut into parts, and every two parts meet in a block of their own."""
    t = float(threshold)
    left, right = (d.select(*(F.col(c).alias(c) for c in ("by", "id", "key"))) for d in (left, right))
    size = lambda d, n: d.groupBy("by").agg(F.count("*").alias(n))
    part = lambda n: F.ceil(F.col(n) / PART).cast("int")
    cuts = size(left, "n").join(size(right, "m"), "by").select("by", "n", "m", part("n").alias("p"), part("m").alias("q"))
    one = cuts.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum(F.col("n") + F.col("m")), F.sum(F.when(F.col("p") * F.col("q") > 1, F.col("p") * F.col("q")))).first()
    blocks = int(min(max((one[0] or 0) / PAIRS, (one[1] or 0) / PART, 1), 4096))
    tasks = int(min(2 * (blocks + (one[2] or 0)), 1024))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        places = [{}, {}]
        for side, own in zip((a, b), places):
            for i, g in enumerate(side.column("by").to_pylist()):
                own.setdefault(g, []).append(i)
        ids = [x.column("id").to_numpy() for x in (a, b)]
        keys = [x.column("key").to_pylist() for x in (a, b)]
        for g in places[0].keys() & places[1].keys():
            at = [np.array(own[g]) for own in places]
            found += [(ids[0][at[0][m]], ids[1][at[1][n]], s) for m, n, s in similar_pairs(*([k[i] for i in x] for k, x in zip(keys, at)), t)]
        x, y, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"left_id": x, "right_id": y, "score": score})

    whole = F.col("p") * F.col("q") == 1
    block = F.when(whole, F.pmod(F.xxhash64("by"), F.lit(blocks))).otherwise(F.xxhash64("by"))

    def of(d: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
        mine = F.pmod(F.hash(F.lit(7), "id"), F.col(own))
        placed = d.join(cuts, "by").select(block.alias("block"), mine.alias(names[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]), F.col("by").alias("by"), F.col("id").cast("long").alias("id"), F.col("key").alias("key"))
        return placed.repartition(tasks, "block", "i", "j").groupBy("block", "i", "j")

    return of(left, "p", "q", ["i", "j"]).cogroup(of(right, "q", "p", ["j", "i"])).applyInArrow(compare, "left_id long, right_id long, score double")


def _first_of_each(d: DataFrame, by: str, order: list[Column], most: int, name: str) -> DataFrame:
    """The first `most` rows of each group, with their place; every task leaves out what cannot be among them before rows are moved."""
    return d.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)


def _kept(citations: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' ids and years with a key for each method, null where a row takes no part. Normal forms cost more than anything but the comparison and are
    asked for several times, so they are worked out once and lie on the executors' disks while the result is in use."""
    key = lambda c, also=F.lit(True): F.when(also & (F.col(c) != ""), sorted_tokens(F.col(c)))
    named = lambda both: (both.alias(METHODS[0]), key("key_title").alias(METHODS[1]))
    left = citations.select("row_id", "recovered_year", *named(key("key_composite", F.expr("key_author <> '' and key_title <> ''"))))
    right = bench.select("bench_row", F.col("year").alias("bench_year"), *named(key("key_composite")))
    return tuple(d.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY) for d in (left, right))


def _stage(citations: DataFrame, bench: DataFrame, method: str, threshold: float, window: int, top: int) -> DataFrame:
    """row_id, bench_row, match_score, match_method: of the `top` most similar papers (the earlier of equals first), the
    first whose year fits. citations, bench: as kept."""
    # Equal keys are compared and their papers ranked once, as rows of one key have the same papers. Of the papers of one key, which are equally similar, only
    # the first `top` can be among a citation's; so rows of equal keys never meet as pairs.
    left, right = (d.where(F.col(method).isNotNull()).select(*d.columns[:2], F.col(method).alias("key")) for d in (citations, bench))
    keys = [left.groupBy("key").agg(F.min("row_id").alias("id")), right.groupBy("key").agg(F.min("bench_row").alias("id"))]
    scored = similar(*keys, threshold, top)
    of = lambda d, k, name: d.join(k.withColumnRenamed("id", name), "key").drop("key")
    papers = of(_first_of_each(right, "key", [F.asc("bench_row")], top, "place").drop("place"), keys[1], "right_id")
    ranked = _first_of_each(scored.join(papers, "right_id"), "left_id", [F.desc("score"), F.asc("bench_row")], top, "rank")
    rows = ranked.join(of(left, keys[0], "left_id"), "left_id")
    fit = rows.where(year_ok(normalise.whole_number(F.col("recovered_year")), F.col("bench_year"), window))
    best = fit.groupBy("row_id").agg(F.min_by(F.struct("bench_row", "score"), "rank").alias("b"))
    return best.select("row_id", F.col("b.bench_row").alias("bench_row"), F.col("b.score").alias("match_score"), F.lit(method).alias("match_method"))


def stage_a(citations: DataFrame, bench: DataFrame, threshold: float = 88, window: int = 2, top: int = 5) -> DataFrame:
    return _stage(*_kept(citations, bench), METHODS[0], threshold, window, top)


def stage_b(citations: DataFrame, bench: DataFrame, threshold: float = 93, window: int = 2, top: int = 5) -> DataFrame:
    return _stage(*_kept(citations, bench), METHODS[1], threshold, window, top)


def found(citations: DataFrame, bench: DataFrame, composite: float = 88, title: float = 93, window: int = 2, top: int = 5) -> DataFrame:
    """Stage A's paper, else stage B's. B is not kept from the rows that A found, which would run A twice; A's rows win."""
    kept = _kept(citations, bench)
    either = _stage(*kept, METHODS[0], composite, window, top).unionByName(_stage(*kept, METHODS[1], title, window, top))
    best = either.groupBy("row_id").agg(F.min_by(F.struct("bench_row", "match_score", "match_method"), "match_method").alias("b"))
    return best.select("row_id", "b.*")


BENCH = {"benchmark_openalex_id": "openalex_id", "bench_doi": "doi", "bench_title": "title", "bench_year": "year", "bench_journal": "journal", "bench_cited_by": "cited_by_count"}


def cluster_id(method: Column, paper: Column, key: Column) -> Column:
    """The paper's id; for an unmatched citation with a key, a hash of it; else null."""
    return F.when(method.isin(*METHODS), paper).when((method == "unmatched") & (key != ""), F.concat(F.lit("unmatched_"), normalise.cluster_hash(key)))


def link(citations: DataFrame, bench: DataFrame, composite: float = 88, title: float = 93, window: int = 2, top: int = 5) -> DataFrame:
    """Every citation once, with its paper where one was found: benchmark columns, match_method, match_score,
    doi_confirmed (the paper's DOI is in the document; no condition), in_benchmark, paper_cluster_id."""
    high, low, other = split(citations)
    keyed, papers = citation_keys(high), benchmark_keys(bench)
    matched = found(keyed, papers, composite, title, window, top)
    known = papers.select("bench_row", "doi_norm", *(F.col(v).alias(k) for k, v in BENCH.items()))
    joined = keyed.join(matched, "row_id", "left").join(known, "bench_row", "left").join(document_dois(citations), "doc_id", "left")
    confirmed = F.coalesce((F.col("doi_norm") != "") & F.array_contains("dois", F.col("doi_norm")), F.lit(False))
    joined = joined.withColumns({"match_method": F.coalesce("match_method", F.lit("unmatched")), "doi_confirmed": confirmed & F.col("bench_row").isNotNull()})
    aside = citation_keys(low).withColumn("match_method", F.lit("low_confidence")).unionByName(citation_keys(other).withColumn("match_method", F.lit("not_academic")))
    everything = joined.unionByName(aside.withColumn("doi_confirmed", F.lit(False)), allowMissingColumns=True)
    added = {"in_benchmark": F.col("match_method").isin(*METHODS), "paper_cluster_id": cluster_id(F.col("match_method"), F.col("benchmark_openalex_id"), F.col("key_composite"))}
    return everything.withColumns(added).drop("bench_row", "doi_norm", "dois", "key_title", "key_author", "key_composite")


def summary(linked: DataFrame, *more: Column) -> DataFrame:
    """Counts of a linkage by state, with further aggregates if given, and the share of joined citations (those of low confidence apart) in per cent."""
    academic = F.coalesce(normalise.flag(F.col("is_academic")), F.lit(False))
    low = F.col("match_method") == "low_confidence"
    out = linked.agg(
        F.count("*").alias("total"), F.count_if(academic).alias("academic"), *(F.count_if(F.col("match_method") == m).alias(m) for m in METHODS), F.count_if(academic & low).alias("low_confidence"),
        F.count_if(F.col("match_method") == "unmatched").alias("unmatched"), F.count_if("doi_confirmed").alias("doi_confirmed"), F.countDistinct(F.when(F.col("in_benchmark"), F.col("paper_cluster_id"))).alias("papers"), *more,
    )
    return out.withColumn("join_rate", 100 * (F.col(METHODS[0]) + F.col(METHODS[1])) / F.greatest(F.col("academic") - F.col("low_confidence"), F.lit(1)))


def ranked(df: DataFrame, section: str, order: list[Column], label: Column, value: Column, most: int | None = None) -> DataFrame:
    """section, place, label, value of the first `most` rows (each task keeps as many, and only those meet), or of all rows of a small table."""
    top = df.orderBy(*order).limit(most) if most is not None else df
    # The few that are left are numbered in one place.
    place = F.row_number().over(Window.orderBy(*order))
    return top.select(F.lit(section).alias("section"), place.alias("place"), label.cast("string").alias("label"), value.cast("double").alias("value"))


def described(df: DataFrame, section: str, value: str, digits: int = 1) -> DataFrame:
    """count, mean, std (of a sample), min, quartiles (exact, linear) and max as rows of a report."""
    v = F.col(value).cast("double")
    names = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
    one = df.agg(F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), *(F.percentile(v, q) for q in (0.25, 0.5, 0.75)), F.max(v)).toDF(*names)
    listed = F.posexplode(F.array(*(F.struct(F.lit(n).alias("label"), F.round(F.col(f"`{n}`").cast("double"), digits).alias("value")) for n in names)))
    return one.select(listed.alias("at", "s")).select(F.lit(section).alias("section"), (F.col("at") + 1).alias("place"), "s.label", "s.value")


def report(linked: DataFrame, most: int = 15, digits: int = 1) -> DataFrame:
    """The whole report on a linkage as rows of section, place, label, value.

    counts: of rows by state, papers and unmatched clusters, and the join rate; journals: matched academic rows by the paper's journal;
    scores: the distribution of their match scores; papers: the most cited matched rows; unmatched: the first unmatched academic rows with a
    title, by row_id, to look through. Ties go by name or row_id. Nothing but the first `most` rows and the aggregates leave the tasks.
    """
    academic = linked.where(F.coalesce(normalise.flag(F.col("is_academic")), F.lit(False)))
    matched = academic.where("in_benchmark")
    one = summary(linked, F.countDistinct(F.when(F.col("match_method") == "unmatched", F.col("paper_cluster_id"))).alias("unmatched_clusters"))
    listed = F.posexplode(F.array(*(F.struct(F.lit(c).alias("label"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in one.columns)))
    counts = one.select(listed.alias("at", "s")).select(F.lit("counts").alias("section"), (F.col("at") + 1).alias("place"), "s.label", "s.value")
    by_journal = matched.where("bench_journal is not null").groupBy("bench_journal").agg(F.count("*").alias("n"))
    journals = ranked(by_journal, "journals", [F.desc("n"), F.asc("bench_journal")], F.col("bench_journal"), F.col("n"))
    papers = ranked(matched.where("bench_cited_by is not null"), "papers", [F.desc("bench_cited_by"), F.asc("row_id")], F.col("recovered_title"), F.col("bench_cited_by"), most)
    aside = ranked(academic.where("match_method = 'unmatched' and recovered_title is not null"), "unmatched", [F.asc("row_id")], F.col("recovered_title"), F.col("recovered_year"), most)
    return counts.unionByName(journals).unionByName(described(matched, "scores", "match_score", digits)).unionByName(papers).unionByName(aside)


def bench_report(bench: DataFrame, years: int = 10, most: int = 15) -> DataFrame:
    """The report on a benchmark as rows of section, place, label, value: total and share of filled abstracts, papers by journal, by year (the last `years` that
    occur, ascending), and the most cited papers. Rows without a journal or year don't count in those sections; ties go by name or id."""
    one = bench.agg(F.count("*").cast("double").alias("papers"), F.avg((F.coalesce("abstract", F.lit("")) != "").cast("double")).alias("abstracts"))
    listed = F.posexplode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in one.columns)))
    whole = one.select(listed.alias("at", "s")).select(F.lit("whole").alias("section"), (F.col("at") + 1).alias("place"), "s.label", "s.value")
    count_by = lambda c: bench.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    journals = ranked(count_by("journal"), "journals", [F.desc("n"), F.asc("journal")], F.col("journal"), F.col("n"))
    last = count_by("year").orderBy(F.desc("year")).limit(years)
    by_year = ranked(last, "years", [F.asc("year")], F.col("year"), F.col("n"), years)
    cited = ranked(bench.where("cited_by_count is not null"), "cited", [F.desc("cited_by_count"), F.asc("openalex_id")], F.col("title"), F.col("cited_by_count"), most)
    return whole.unionByName(journals).unionByName(by_year).unionByName(cited)


def author_seed(bench: DataFrame, seeds: DataFrame) -> DataFrame:
    """author: distinct ids of both tables' author_ids (JSON lists)."""
    ids = lambda d: d.select(F.explode(F.from_json("author_ids", "array<string>")).alias("author"))
    return ids(bench).union(ids(seeds)).distinct()


def network_filter(papers: DataFrame, authors: DataFrame, least: int = 1) -> DataFrame:
    """Papers with at least `least` distinct authors of the seed, with n_finance_community_authors."""
    listed = papers.select("openalex_id", F.explode(F.array_distinct(F.from_json("author_ids", "array<string>"))).alias("author"))
    counted = listed.join(authors, "author", "left_semi").groupBy("openalex_id").agg(F.count("*").alias("n_finance_community_authors"))
    return papers.join(counted.where(F.col("n_finance_community_authors") >= least), "openalex_id")
