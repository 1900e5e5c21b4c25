"""Text, titles and links of HTML pages. What built-in functions can't parse is read by the standard library's parser, in
Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalise import safe_file_name

# The elements that begin a block, and those that hold no article text.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "li", "br")
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form")


class _Reader(HTMLParser):
    """Collects strings; `before` elements get a break, `dropped` ones lose what they hold; with `inside`, only the first
    element of that name (or class, with a dot before it) is read. An `ampersand` in the data stands for a plain one."""

    def __init__(self, before=(), dropped=(), inside: str | None = None, ampersand: str = "&"):
        super().__init__(convert_charrefs=True)
        self.ampersand = ampersand
        self.before, self.dropped, self.inside = frozenset(before), frozenset(dropped), inside
        self.out: list[str] = []
        self.deep = self.open = 0
        self.found = self.over = False
        self.kind = ""

    def _is_inside(self, tag, attrs) -> bool:
        if self.inside.startswith("."):
            return self.inside[1:] in (dict(attrs).get("class") or "").split()
        return tag == self.inside

    def handle_starttag(self, tag, attrs):
        if self.inside and not self.over:
            # Only elements of its own name are counted, as pages leave others open.
            if self.open:
                self.open += tag == self.kind
            elif self._is_inside(tag, attrs):
                self.open, self.found, self.kind = 1, True, tag
        if tag in self.dropped:
            self.deep += 1
        elif tag in self.before and self._reading():
            self.out.append("\n\n")

    def handle_startendtag(self, tag, attrs):
        if tag in self.before and self._reading():
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.dropped and self.deep:
            self.deep -= 1
        if self.inside and self.open and tag == self.kind:
            self.open -= 1
            self.over = self.open == 0

    def _reading(self) -> bool:
        return not self.deep and (not self.inside or self.open > 0)

    def handle_data(self, data):
        if self._reading():
            self.out.append(data.replace(self.ampersand, "&"))


_REFERENCE = re.compile(r"&(#(?:[0-9]+|[xX][0-9A-Fa-f]+);|[A-Za-z][A-Za-z0-9]*;)?")


def _read(html: str, closed: bool = False, **how) -> _Reader:
    """closed: character references without a semicolon are text; otherwise those that HTML knows so are read too."""
    mark = "&"
    if closed:
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
        html = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], html)
    reader = _Reader(**how, ampersand=mark)
    reader.feed(html)
    reader.close()
    return reader


def blocks_of(html: str, closed: bool = False) -> str:
    return re.sub(r"\n{3,}", "\n\n", "".join(_read(html, closed, before=BLOCKS).out)).strip()


def clean_of(html: str, closed: bool = False) -> str:
    parts = [s for s in (x.strip() for x in _read(html, closed, dropped=DROPPED).out) if s]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parts))


def main_of(html: str, selectors: tuple[str, ...], closed: bool = False) -> str:
    for s in (*selectors, "body"):
        reader = _read(html, closed, before=BLOCKS, dropped=("script", "style"), inside=s)
        if reader.found:
            return re.sub(r"\n{3,}", "\n\n", "".join(reader.out)).strip()
    return ""


def _mapped(html: Column | str, f: Callable[[str], str]) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(f, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(html)


def text_blocks(html: Column | str, closed: bool = False) -> Column:
    """Text with an empty line before each block. closed: only character references that end in a semicolon are read."""
    return _mapped(html, lambda x: blocks_of(x, closed))


def text_clean(html: Column | str, closed: bool = False) -> Column:
    """Stripped strings of the article, a line each, without navigation and the like."""
    return _mapped(html, lambda x: clean_of(x, closed))


def main_block(html: Column | str, selectors: tuple[str, ...] = ("article", "main", ".content"), closed: bool = False) -> Column:
    """Text of the first selector (element name, or class with a dot) that the page has, else of its body."""
    return _mapped(html, lambda x: main_of(x, selectors, closed))


def title(html: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    return F.when(found != "", found).otherwise(fallback)


def slug_of_url(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def with_header(source: Column, title_: Column, date: Column, body: Column) -> Column:
    dated = F.when(date.isNotNull(), F.concat(F.lit("DATE: "), date, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("SOURCE: "), source, F.lit("\nTITLE: "), title_, F.lit("\n"), dated, F.lit("\n"), body)


def hrefs(html: Column, pattern: str = ".*") -> Column:
    """Distinct link targets in order of appearance that match a pattern."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)))
    return F.filter(found, lambda h: h.rlike(pattern))


def best_link(html: Column, tiers: tuple[str, ...]) -> Column:
    """The first link of the first tier (a pattern) that has one."""
    links = hrefs(html)
    return F.coalesce(*(F.get(F.filter(links, lambda h: h.rlike(tier)), F.lit(0)) for tier in tiers))


def attribute(html: Column, name: str, ending: str) -> Column:
    """Distinct values of an attribute with an ending, in order."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(rf'(?i)\b{name}="([^"]*)"'), F.lit(1)))
    return F.filter(found, lambda v: F.lower(v).endswith(ending))


def article_parts(href: Column, pattern: str = r"/(\d+)/(\d+)/(\d+)$") -> dict[str, Column]:
    return {n: F.nullif(F.regexp_extract(href, pattern, i), F.lit("")) for i, n in enumerate(("vol", "issue", "startpage"), 1)}


def dois_of_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'/doi/epdf/([^"?]+)'), F.lit(1)))


def url_class(url: Column, short: tuple[str, ...], ending: str = ".pdf") -> Column:
    low = F.lower(url)
    is_short = F.lit(False)
    for s in short:
        is_short = is_short | low.contains(s)
    return F.when(is_short, "skip_short").when(~low.endswith(ending), "skip_no_pdf").otherwise("keep")


def sections(html: Column) -> Column:
    """(section, title, href) of links, each under the last h2 before it."""
    parts = F.split(html, r"(?i)<h2[^>]*>")
    named = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.trim(F.regexp_extract(p, r"(?is)^(.*?)</h2>", 1)).alias("section"), F.regexp_extract_all(p, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1)).alias("links")))
    flat = F.flatten(F.transform(named, lambda s: F.transform(s["links"], lambda a: F.struct(s["section"].alias("section"), F.trim(F.regexp_replace(a, r"<[^>]*>", "")).alias("title"), F.regexp_extract(a, r'(?i)href="([^"]*)"', 1).alias("href")))))
    return flat


#: Titles of older issues that are no articles, and the section that holds them in newer ones.
SKIPPED_TITLES = ("a message from the editor", "message from the editor", "message form the editor", "executive summar", "issue information")
KEPT_SECTION = "original article"


def articles(listed: Column, kept: str = KEPT_SECTION, skipped: tuple[str, ...] = SKIPPED_TITLES) -> Column:
    """Of (section, title, href) of an issue: those of the kept section; in an issue that names no section at all, those whose title has none of the
    fragments. An empty or null href doesn't count; case doesn't matter."""
    linked = F.filter(F.coalesce(listed, F.array()), lambda x: F.coalesce(x["href"], F.lit("")) != "")
    named = F.exists(linked, lambda x: F.coalesce(x["section"], F.lit("")) != "")
    inside = lambda x: F.contains(F.lower(F.coalesce(x["section"], F.lit(""))), F.lit(kept))
    fine = lambda x: ~reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(x["title"], F.lit(""))), F.lit(f)) for f in skipped], F.lit(False))
    return F.filter(linked, lambda x: F.when(named, inside(x)).otherwise(fine(x)))


def issue_links(html: Column) -> Column:
    """(section, title, href) of an issue's links, also of those before any heading, whose section is empty."""
    before = F.regexp_extract(html, r"(?is)^(.*?)(?:<h2[\s>]|$)", 1)
    loose = F.transform(F.regexp_extract_all(before, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1)), lambda a: F.struct(F.lit("").alias("section"), F.trim(F.regexp_replace(a, r"<[^>]*>", "")).alias("title"), F.regexp_extract(a, r'(?i)href="([^"]*)"', 1).alias("href")))
    return F.concat(F.coalesce(loose, F.array()), F.coalesce(sections(html), F.array()))


def enough_text(html: Column | str, least: int = 100) -> Column:
    """Whether a page's extracted text is long enough to be kept; a null page's isn't."""
    return F.coalesce(F.length(F.trim(text_clean(html))) >= least, F.lit(False))


def routed(category: Column, login: Column, url: Column, internal: str) -> Column:
    """Only open articles with an address; where they are read from."""
    good = (category == "Articles") & ~F.coalesce(login, F.lit(False)) & (F.coalesce(url, F.lit("")) != "")
    return F.when(good & url.startswith(internal), "internal").when(good, "external")


def open_only(locked: Column) -> Column:
    """Whether a publication is not locked; one that doesn't say is open."""
    return ~F.coalesce(locked, F.lit(False))


def archived_name(url: Column, longest: int = 80) -> Column:
    """The name of an archived file: the last part of its path, or, where that is no PDF's, the whole path; always with the ending."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    whole = F.concat(safe_file_name(F.replace(path, F.lit("/"), F.lit("_")), longest), F.lit(".pdf"))
    name = safe_file_name(F.when(F.lower(last).endswith(".pdf"), last).otherwise(whole), longest)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def archive_rows(listing: DataFrame, base: str, header: str = "timestamp") -> DataFrame:
    """archived, name of each row of a listing (timestamp, original) but its header."""
    kept = listing.where(~F.col("timestamp").eqNullSafe(header))
    return kept.withColumns({"archived": archived_url(F.col("timestamp"), F.col("original"), base), "name": archived_name(F.col("original"))})


def archived_url(stamp: Column, url: Column, base: str) -> Column:
    return F.concat(F.lit(base), stamp, F.lit("id_/"), url)
