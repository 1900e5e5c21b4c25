"""Normal forms of names, venues, titles, identifiers, addresses and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


# The patterns of venue(), venue_ascii(), title(), doi() and first_author() below, and their order.


def venue(name: Column) -> Column:
    """Lower case, & as and, no parentheses, no volume tail, no punctuation, no leading `the`; null if nothing is left.
    The volume rule has no word boundary, so `casino royale` is cut to `casi`."""
    c = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"\([^)]*\)", "")
    c = F.regexp_replace(c, r"(?U),?\s*(vol\.?|volume|issue|no\.?|number)\s.*$", "")
    c = _strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), WHITESPACE, " "))
    return _blank_to_null(F.regexp_replace(c, r"(?U)^the\s+", ""))


def venue_ascii(name: Column) -> Column:
    """The editor's variant: ASCII only, volumes stay."""
    c = F.regexp_replace(F.replace(_strip(F.lower(name)), F.lit("&"), F.lit("and")), r"\([^)]*\)", "")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]+", " "), r" +", " "))
    return F.when(c.startswith("the "), F.substring(c, F.lit(5), F.length(c))).otherwise(c)


def title(text: Column) -> Column:
    """Lower case, no leading article, word characters, white space and hyphens only; empty for null."""
    c = F.regexp_replace(_strip(F.lower(F.coalesce(text, F.lit("")))), r"(?U)^(the|a|an)\s+", "")
    return _strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s\-]", " "), WHITESPACE, " "))


def doi(text: Column) -> Column:
    return F.regexp_replace(_strip(F.lower(F.coalesce(text, F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")


def doi_set(listed: Column) -> Column:
    """Distinct DOIs of a JSON list; empty where it isn't one."""
    items = F.from_json(listed, "array<string>")
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array()), doi)))


def first_author(authors: Column) -> Column:
    """The first of a JSON list, else of a list parted by commas or semicolons; normalised, empty if there is none."""
    parsed = F.get(F.from_json(authors, "array<string>"), F.lit(0))
    return F.coalesce(title(F.coalesce(parsed, F.get(F.split(authors, "[,;]"), F.lit(0)))), F.lit(""))


def composite_key(title_text: Column, authors: Column) -> Column:
    t, a = title(title_text), first_author(authors)
    return F.when((t != "") & (a != ""), F.concat_ws(" ", t, a)).otherwise(t)


def cluster_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 8)


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)


def flag(value: Column) -> Column:
    """True, false or null from text of either."""
    s = _strip(F.lower(value.cast("string")))
    return F.when(s.isin("true", "1", "yes", "t"), True).when(s.isin("false", "0", "no", "f"), False)


def whole_number(value: Column) -> Column:
    """An integer through a double: `1992.0` is 1992; null where it is none."""
    number = value.try_cast("double")
    return (F.floor(F.abs(number)) * F.signum(number)).cast("int")


def slug(text: Column, separator: str = "_", longest: int = 60, keep_hyphen: bool = False) -> Column:
    """Lower-case words joined by a separator."""
    cleaned = _strip(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", ""))
    joined = F.regexp_replace(cleaned, r"[\s_]+" if keep_hyphen else r"[\s_-]+", separator)
    return F.substring(joined, 1, longest)


def ascii_slug(text: Column, longest: int = 120) -> Column:
    """Letters without their marks, joined by hyphens. Marks of Latin letters are folded by a table of pairs."""
    # Precomposed Latin letters and their base letters.
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    base = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    folded = F.regexp_replace(F.translate(text, marked, base), r"[^\x00-\x7F]", "")
    return slug(folded, "-", longest)


def safe_file_name(text: Column, longest: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")), 1, longest)


def url_uid(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 6)


def flattened_name(folder: Column, name: Column) -> Column:
    return F.concat(folder, F.lit("__"), name)


def absolute_url(base: str, href: Column) -> Column:
    return F.when(href.rlike(r"^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def https(url: Column) -> Column:
    return F.regexp_replace(url, r"^http://", "https://")
