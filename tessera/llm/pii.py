"""Personal data: direct identifiers by rule, and terms that give them away by what the corpus tells.

A term (word) discloses an entity (a found identifier) if it mostly occurs where that entity does. The corpus is asked:
in how many distinct contexts of the entity does the term stand, how often does it occur beside the entity, and how often at
all? Both are counted in all rows, outside identifiers. The share of the two estimates P(entity | term); the gain over P(entity) is measured in bits. Terms over both thresholds are sensitive, or of a share near 1 alone:
they are generalised, and removed where the share reaches a higher one. Equal contexts (copies) count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import ALNUM, LOWER, hashes, mix, parts, words
from .common import batch, cut, with_fields

KINDS = ("email", "ip", "card", "phone")
#: Terms in one broadcast block (8 bytes and a flag each); more terms are more blocks.
BLOCK_TERMS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address holds the whole run of local characters before its @, back to the end of the address before."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield left, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) in characters, ascending. Candidates are leftmost and don't overlap within a kind;
    one that fails its test (parts, digits, checksum) is dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SIGN = np.zeros(256, np.int64)
_SIGN[0x30:0x3A] = 1
_AT = np.zeros(256, np.int64)
_AT[0x40] = 1


def _found(data: np.ndarray, off: np.ndarray) -> dict[int, tuple[str, list[tuple[int, int, int]]]]:
    """Row: (text, base spans), for rows that have any. Only rows with an @ or at least four digits can have one."""
    digits, ats = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SIGN[data], out=digits[1:])
    np.cumsum(_AT[data], out=ats[1:])
    rows = np.flatnonzero((np.diff(digits[off]) >= 4) | (np.diff(ats[off]) > 0))
    out = {}
    for r in rows.tolist():
        text = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
        if spans := base_spans(text):
            out[r] = (text, spans)
    return out


def _byte_places(raw: np.ndarray) -> np.ndarray:
    """The byte at which each character begins, and the end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def _edges(text: str, spans: list[tuple[int, int, int]], raw: np.ndarray, begin: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """For each span, its words (first, end) among those of its row, which begins at byte `begin`."""
    place = _byte_places(raw) + begin
    return [(int(np.searchsorted(ends, place[s], "right")), int(np.searchsorted(starts, place[e]))) for s, _, e in spans]


def contexts(docs: DataFrame, reach: int) -> DataFrame:
    """entity, term, context (hashes), beside: the words up to `reach` words around each found identifier; and, without a
    context, how many occurrences of the term in a row are in reach of the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in parts(b.column("text")):
                found = _found(data, off)
                out: list[tuple[int, int, int | None, int]] = []
                if found:
                    low = LOWER[data]
                    starts, ends, at = words(low, off, ALNUM)
                    h = hashes(low, starts, ends)
                for r, (text, spans) in found.items():
                    own = slice(at[r], at[r + 1])
                    free = np.ones(at[r + 1] - at[r], bool)
                    edges = _edges(text, spans, data[off[r] : off[r + 1]], off[r], starts[own], ends[own])
                    for i, j in edges:
                        free[i:j] = False
                    reached: dict[int, list[np.ndarray]] = {}
                    for (s, k, e), (i, j) in zip(spans, edges):
                        value = text[s:e].lower() if k == 0 else text[s:e] if k == 1 else _NOT_DIGIT.sub("", text[s:e])
                        entity = int.from_bytes(hashlib.blake2b(f"{KINDS[k]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)
                        near = np.concatenate([np.arange(max(0, i - reach), i), np.arange(j, min(len(free), j + reach))])
                        near = near[free[near]]
                        reached.setdefault(entity, []).append(near)
                        near = h[own][near]
                        if len(near):
                            context = int(mix(near * np.arange(1, 2 * len(near), 2, dtype=np.uint64)).sum().view(np.int64))
                            out.extend((entity, t, context, 0) for t in np.unique(near).view(np.int64).tolist())
                    for entity, places in reached.items():
                        terms, times = np.unique(h[own][np.unique(np.concatenate(places))], return_counts=True)
                        out.extend((entity, t, None, n) for t, n in zip(terms.view(np.int64).tolist(), times.tolist()))
                yield batch(**{c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("entity", "term", "context", "beside"))})

    return docs.select("text").mapInArrow(run, "entity long, term long, context long, beside long")


def _blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The hashes of a table of distinct terms, ascending, in blocks of bounded size."""
    n = terms.count()
    blocks = -(-n // BLOCK_TERMS)
    for k in range(blocks):
        part = terms.where(F.pmod("term", F.lit(blocks)) == k).toArrow()
        yield np.sort(part.column("term").to_numpy().astype(np.int64).view(np.uint64))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the given terms occurs in all documents, outside identifiers."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "term long, n long")
    for known in _blocks(terms):
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            total = np.zeros(len(known), np.int64)
            for b in batches:
                for _, _, data, off in parts(b.column("text")):
                    low = LOWER[data]
                    starts, ends, at = words(low, off, ALNUM)
                    free = np.ones(len(starts), bool)
                    for r, (text, spans) in _found(data, off).items():
                        own = slice(at[r], at[r + 1])
                        for i, j in _edges(text, spans, data[off[r] : off[r + 1]], off[r], starts[own], ends[own]):
                            free[own][i:j] = False
                    h = hashes(low, starts[free], ends[free])
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    total += np.bincount(i[known[i] == h], minlength=len(known))
            at = np.flatnonzero(total)
            yield batch(term=pa.array(known[at].view(np.int64)), n=pa.array(total[at]))

        out = out.unionByName(docs.select("text").mapInArrow(run, "term long, n long"))
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def sensitive_terms(docs: DataFrame, reach: int = 8, least_contexts: int = 3, least_share: float = 0.5, least_bits: float = 4.0, removal_share: float = 0.9) -> DataFrame:
    """term (hash), remove: terms that disclose an entity. least_contexts: distinct contexts of the entity with the term;
    least_share: of P(entity | term); least_bits: of log2(P(entity | term) / P(entity)), P(entity) being its share of all contexts; removal_share: from which share
    on a term is removed, not generalised, and discloses whatever the bits, which are few for an entity with many contexts."""
    found = cut(contexts(docs, reach).groupBy("entity", "term", "context").agg(F.sum("beside").alias("beside")))
    seen = found.where("context is not null")
    joint = found.groupBy("entity", "term").agg(F.count("context").alias("together"), F.sum("beside").alias("beside")).where(F.col("together") >= least_contexts)
    joint = cut(joint)
    counted = occurrences(docs, joint.select("term").distinct())
    by_entity = seen.groupBy("entity").agg(F.countDistinct("context").alias("of_entity"))
    all_contexts = seen.select("entity", "context").distinct().count()
    share = F.col("beside") / F.col("n")
    bits = F.log2(share / (F.col("of_entity") / F.lit(max(all_contexts, 1))))
    told = joint.join(counted, "term").join(by_entity, "entity").withColumn("share", share).where((share >= least_share) & ((bits >= least_bits) | (share >= removal_share)))
    return cut(told.groupBy("term").agg((F.max("share") >= removal_share).alias("remove")))


def find(docs: DataFrame, terms: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then for every row: spans (array of kind, start, end in characters, end exclusive; by start,
    then kind as in KINDS, terms last) and sanitised (the text with identifiers replaced by their kind, sensitive terms
    generalised to [TERM] or removed; null if there is nothing to replace). A null text has no spans."""
    spark = docs.sparkSession
    shared = []
    for known in _blocks(terms.select("term")):
        shared.append(spark.sparkContext.broadcast(known))
    gone = [spark.sparkContext.broadcast(x) for x in _blocks(terms.where("remove").select("term"))]
    fields = {f.name: f for f in docs.select(*keep).schema.fields}

    def member(h: np.ndarray, blocks) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for x in blocks:
            known = x.value
            out |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*KINDS, "term")
        for b in batches:
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            clean: list[str | None] = [None] * b.num_rows
            for lo, _, data, off in parts(b.column("text")):
                found = _found(data, off)
                extra: dict[int, list[tuple[int, int, bool]]] = {}
                if shared:
                    low = LOWER[data]
                    starts, ends, at = words(low, off, ALNUM)
                    h = hashes(low, starts, ends)
                    hit = np.flatnonzero(member(h, shared))
                    dropped = member(h[hit], gone)
                    for w, r, x in zip(hit.tolist(), (np.searchsorted(at, hit, "right") - 1).tolist(), dropped.tolist()):
                        extra.setdefault(r, []).append((int(starts[w]), int(ends[w]), x))
                for r in found.keys() | extra.keys():
                    raw = data[off[r] : off[r + 1]]
                    text, base = found.get(r) or (raw.tobytes().decode("utf-8", "replace"), [])
                    marked = [(s, k, e, f"[{names[k].upper()}]") for s, k, e in base]
                    if r in extra:
                        place = _byte_places(raw) + off[r]
                        for s, e, x in extra[r]:
                            s, e = int(np.searchsorted(place, s)), int(np.searchsorted(place, e))
                            if all(e <= a or z <= s for a, _, z in base):
                                marked.append((s, len(KINDS), e, "" if x else "[TERM]"))
                    marked.sort()
                    spans[lo + r] = [{"kind": names[k], "start": s, "end": e} for s, k, e, _ in marked]
                    done, out = 0, []
                    for s, _, e, instead in marked:
                        if s >= done:
                            out += [text[done:s], instead]
                        done = max(done, e)
                    clean[lo + r] = "".join([*out, text[done:]]) if marked else None
            kept = {c: b.column(c) for c in fields}
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield batch(**kept, spans=pa.array(spans, kind), sanitised=pa.array(clean, pa.string()))

    schema = with_fields(list(fields.values()), "spans array<struct<kind: string, start: long, end: long>>, sanitised string")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
