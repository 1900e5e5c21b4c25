"""Judgement of files by their names, in tiers, and other rules by fragments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(fragments: tuple[str, ...]) -> str:
    """One pattern for many fragments, branching where they do (a trie), so a text is read once however many there are. Of fragments that begin at one place, the longest
    is found."""
    trie: dict = {}
    for f in fragments:
        node = trie
        for c in f:
            node = node.setdefault(c, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = [re.escape(c) + branch(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    return branch(trie)


@dataclass(frozen=True)
class JunkRules:
    """Names of files that are no documents: whole stems, fragments, and patterns by name. Stems and fragments are compared in lower case."""

    stems: tuple[str, ...] = ()
    fragments: tuple[str, ...] = ()
    patterns: dict[str, str] = field(default_factory=dict)


def stem(path: Column) -> Column:
    """The lower-cased name of a file without folder and ending; a name that begins with its only dot has no ending."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    return F.lower(name)


def junk(path: Column, rules: JunkRules) -> Column:
    """A struct of tier (stem, fragment, pattern) and hit (the stem, the leftmost fragment, the first pattern's name) of the first tier that
    applies; null for a name that none does, and for a null path."""
    s = stem(path)
    out = F.lit(None).cast("struct<tier: string, hit: string>")
    told = lambda tier, hit: F.struct(F.lit(tier).alias("tier"), hit.alias("hit"))
    for name, pattern in reversed(rules.patterns.items()):
        out = F.when(s.rlike(pattern), told("pattern", F.lit(name))).otherwise(out)
    if fragments := tuple(f.lower() for f in rules.fragments if f):
        found = F.regexp_extract(s, any_of(fragments), 0)
        out = F.when(found != "", told("fragment", found)).otherwise(out)
    if rules.stems:
        out = F.when(s.isin([x.lower() for x in rules.stems]), told("stem", s)).otherwise(out)
    return out


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """The entry of a small table; the default for keys that it lacks, and for null."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def first_fragment(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The label of the first rule (fragment, label) whose fragment stands in the text, whatever its case."""
    low, out = F.lower(text), F.lit(default)
    for fragment, label in reversed(rules):
        out = F.when(F.contains(low, F.lit(fragment.lower())), label).otherwise(out)
    return out


def has_prefix(name: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a name begins with one of the prefixes, whatever its case: parts of a work that is there as a whole."""
    low, out = F.lower(name), F.lit(False)
    for p in prefixes:
        out = out | F.startswith(low, F.lit(p.lower()))
    return F.coalesce(out, F.lit(False))


def has_topic(texts: list[Column], keywords: tuple[str, ...]) -> Column:
    """Whether a keyword stands in any of the texts, whatever its case."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return joined.rlike(any_of(tuple(k.lower() for k in keywords))) if keywords else F.lit(False)


def enough_pages(pages: Column, least: int = 6, unknown: int = 999) -> Column:
    """Whether a document is long enough; an unknown number of pages is."""
    return F.coalesce(pages, F.lit(unknown)) >= least


def pdf_checks(content: Column, least_bytes: int = 5000) -> dict[str, Column]:
    """Three readings of a file's first bytes: starts (with the mark), near (within ten bytes), sound (mark and dash, and not too short)."""
    head = F.decode(F.substring(content, 1, 10), "ISO-8859-1")
    return {"starts": head.startswith("%PDF"), "near": head.contains("%PDF"), "sound": head.startswith("%PDF-") & (F.octet_length(content) >= least_bytes)}


def marker_counts(content: Column, markers: tuple[str, ...]) -> list[Column]:
    """How often each marker stands in raw bytes, whatever their encoding."""
    raw = F.decode(content, "ISO-8859-1")
    return [F.regexp_count(raw, F.lit(re.escape(m))) for m in markers]


def malformed(href: Column) -> Column:
    """Whether an address holds a triple colon, plain or escaped."""
    return F.coalesce(href.rlike(r":::|%3[Aa]%3[Aa]%3[Aa]"), F.lit(False))
