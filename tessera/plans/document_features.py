"""Document feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise, text
from ..operators import flatten, merge, names
from .registry import query

#: A document with an invented page count and path, as the fixtures have none.
PAPERS = """
SELECT doc_id, text, source, n_chars, CAST(n_chars % 37 AS INT) AS pages, n_chars % 5 = 0 AS is_text,
       concat('/corpus/', source, '/', CAST(1970 + n_chars % 61 AS VARCHAR(4)), '_paper.pdf') AS path,
       CASE WHEN n_chars % 2 = 0 THEN concat(text, chr(10), 'References', chr(10), 'A Study of 10.1000/', source, chr(10)) ELSE text END AS body
FROM {documents}
"""
PAPERS_SPARK = PAPERS.replace("VARCHAR(4)", "STRING")
_D = f"WITH d AS ({PAPERS}) "
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(body, ''), '\s+'), lambda x: x <> ''))"
_QUALITY = f"CASE WHEN is_text THEN 'html_derived' WHEN {_WORDS} / greatest(pages, 1) < 50 THEN 'likely_scanned' ELSE 'native_text' END"
_MARKERS = ("references and further reading", "references\n", "bibliography\n", "further reading\n", "footnotes\n")
_LIT = [m.replace("\n", "' || chr(10) || '") for m in _MARKERS]
#: Shorter than the default, so that fixtures have long texts.
LIMIT = 3000


def papers(t):
    return t.view(PAPERS_SPARK)


def _sql_last(marker: str) -> str:
    n = len(marker)
    lit = "'" + marker.replace("\n", "' || chr(10) || '") + "'"
    return f"CASE WHEN contains(lower(body), {lit}) THEN length(body) - strpos(reverse(lower(body)), reverse({lit})) + 1 - {n} END"


_START = "coalesce(" + ", ".join(map(_sql_last, _MARKERS)) + ")"


@query(_D + f"SELECT doc_id, {_WORDS} AS words, length(coalesce(body, '')) AS chars, pages FROM d")
def doc_counts(t):
    return papers(t).select("doc_id", text.word_count(F.col("body")).alias("words"), text.char_count(F.col("body")).alias("chars"), "pages")


@query(_D + f"SELECT doc_id, {_QUALITY} AS quality FROM d")
def doc_quality(t):
    return papers(t).select("doc_id", text.extraction_quality(text.word_count(F.col("body")), F.col("pages"), F.col("is_text")).alias("quality"))


@query(_D + "SELECT doc_id, " + " OR ".join(f"contains(substr(lower(body), CAST(floor(length(body) * 0.6) AS INT) + 1), '{m}')" for m in _LIT) + " AS has_bib FROM d")
def doc_has_bib(t):
    return papers(t).select("doc_id", text.has_bibliography(F.col("body")).alias("has_bib"))


@query(_D + f"SELECT doc_id, {_START} AS ref_start FROM d")
def doc_ref_start(t):
    return papers(t).select("doc_id", text.reference_start(F.col("body")).alias("ref_start"))


@query(_D + f"""SELECT doc_id, md5(CASE WHEN length(body) <= {LIMIT} THEN body
  WHEN NOT is_text AND {_START} IS NOT NULL THEN substr(body, 1, 600) || chr(10) || chr(10) || '[...body truncated...]' || chr(10) || chr(10) || substr(body, {_START} + 1)
  ELSE substr(body, 1, 800) || chr(10) || chr(10) || '[...middle truncated...]' || chr(10) || chr(10) || right(body, 400) END) AS sent_md5 FROM d""")
def doc_truncate(t):
    sent = text.truncated(F.col("body"), ~F.col("is_text"), LIMIT, 800, 400, 600)
    return papers(t).select("doc_id", F.md5(sent.cast("binary")).alias("sent_md5"))


@query(_D + f"""SELECT doc_id, CASE WHEN length(body) <= {LIMIT} THEN 'full' WHEN NOT is_text AND {_START} IS NOT NULL THEN 'refs@' || {_START} ELSE 'first+last' END AS strategy,
  CASE WHEN length(body) > {LIMIT} AND NOT is_text AND {_START} IS NOT NULL THEN {_START} ELSE -1 END AS ref_char FROM d""")
def doc_strategy(t):
    by = (F.col("body"), ~F.col("is_text"), LIMIT)
    return papers(t).select("doc_id", text.strategy(*by).alias("strategy"), text.reference_char(*by).alias("ref_char"))


_FULL = text.FULL_TEXT_LIMIT


@query(_D + f"""SELECT doc_id, CASE WHEN length(body) <= {_FULL} THEN 'full' WHEN NOT is_text AND {_START} IS NOT NULL THEN 'refs@' || {_START} ELSE 'first+last' END AS strategy, CASE WHEN length(body) > {_FULL} AND NOT is_text AND {_START} IS NOT NULL THEN {_START} ELSE -1 END AS ref_char,
  md5(CASE WHEN length(body) <= {_FULL} THEN body WHEN NOT is_text AND {_START} IS NOT NULL THEN substr(body, 1, 6000) || chr(10) || chr(10) || '[...body truncated...]' || chr(10) || chr(10) || substr(body, {_START} + 1)
  ELSE substr(body, 1, 8000) || chr(10) || chr(10) || '[...middle truncated...]' || chr(10) || chr(10) || right(body, 4000) END) AS sent_md5 FROM d""")
def doc_sent_text(t):
    """What is sent of each document by the production limits."""
    by = (F.col("body"), ~F.col("is_text"))
    return papers(t).select("doc_id", text.strategy(*by).alias("strategy"), text.reference_char(*by).alias("ref_char"), F.md5(text.truncated(*by).cast("binary")).alias("sent_md5"))


@query("SELECT doc_id, round_even(least(length(text), 2500) / greatest(n_chars, 1), 4) AS ratio FROM documents")
def doc_char_ratio(t):
    return t.documents.select("doc_id", text.char_ratio(F.least(F.length("text"), F.lit(2500)), F.col("n_chars")).alias("ratio"))


#: A synthetic source map; the operators take any.
SOURCE_TYPES = {f"src{i}": f"{('journal', 'report', 'post')[i % 3]}_{i}" for i in range(15)}
INSTITUTIONS = {v: f"Institution {v[-1]}" for v in list(SOURCE_TYPES.values())[:10]}


def _sql_lookup(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


_TYPE = _sql_lookup("lower(source)", SOURCE_TYPES, "other_practitioner")


@query(f"SELECT doc_id, {_TYPE} AS source_type FROM documents")
def doc_source_type(t):
    return t.documents.select("doc_id", names.lookup(F.lower("source"), SOURCE_TYPES, "other_practitioner").alias("source_type"))


@query(f"WITH d AS (SELECT doc_id, {_TYPE} AS source_type FROM documents) SELECT doc_id, {_sql_lookup('source_type', INSTITUTIONS, 'Unknown')} AS institution FROM d")
def doc_institution(t):
    return t.documents.select("doc_id", names.lookup(names.lookup(F.lower("source"), SOURCE_TYPES, "other_practitioner"), INSTITUTIONS, "Unknown").alias("institution"))


@query("SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'first' WHEN contains(source, '2') THEN 'second' ELSE 'other' END AS source_type FROM documents")
def doc_source_type_v0(t):
    """The older cascade: the first rule whose fragment stands in the path."""
    return t.documents.select("doc_id", names.first_fragment(F.col("source"), (("src1", "first"), ("2", "second")), "other").alias("source_type"))


@query(_D + r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(path, '(19[89]\d|20[012]\d)', 1), '') AS INT) AS year_path FROM d")
def doc_year_path(t):
    return papers(t).select("doc_id", text.year_from_path(F.col("path")).alias("year_path"))


@query(_D + r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(body, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+'))) AS dois FROM d")
def doc_dois(t):
    return papers(t).select("doc_id", text.dois(F.col("body")).alias("dois"))


@query(_D + f"""SELECT doc_id, CASE WHEN {_WORDS} = 0 THEN 'skipped_no_text' WHEN {_QUALITY} = 'likely_scanned' THEN 'skipped_likely_scanned' ELSE 'ok' END AS status,
  CASE WHEN {_WORDS} > 0 AND {_QUALITY} = 'likely_scanned' THEN 'skipped_likely_scanned_wpp_' || printf('%.1f', {_WORDS} / greatest(pages, 1)) END AS note FROM d""")
def doc_skip_status(t):
    d = papers(t).withColumn("words", text.word_count(F.col("body")))
    d = d.withColumn("quality", text.extraction_quality(F.col("words"), F.col("pages"), F.col("is_text")))
    return d.select("doc_id", text.skip_status(F.col("words"), F.col("quality"), F.lit("ok")).alias("status"), text.skip_note(F.col("words"), F.col("pages"), F.col("quality")).alias("note"))


_FENCED = "SELECT event_id, concat('```json', chr(10), props, chr(10), '```') AS raw FROM {events}"


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def doc_fence_strip(t):
    """Fenced JSON answers, as a model gives them, parsed."""
    return t.view(_FENCED).select("event_id", F.from_json(text.strip_fence(F.col("raw")), "k int")["k"].alias("k"))


@query("SELECT c.conv_id, c.turn, c.role, d.lang, d.source FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def doc_denorm(t):
    """Citation rows with the fields of their document."""
    cited = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "role")
    return merge.with_document(cited, t.documents, ("lang", "source"), "inner").withColumnRenamed("doc_id", "conv_id")


_HEAD = r"regexp_matches(lower(body), '\n\s*references\s*\n')"


@query(_D + rf"""SELECT doc_id, md5(substr(body, 1, 5000)) AS intro_md5, md5(CASE WHEN {_HEAD} THEN substr(body, strpos(lower(body), regexp_extract(lower(body), '\n\s*references\s*\n')), 8000)
  WHEN length(body) > 5000 THEN right(body, 8000) ELSE '' END) AS refs_md5 FROM d""")
def doc_excerpt(t):
    b = F.col("body")
    return papers(t).select("doc_id", F.md5(text.excerpt_intro(b).cast("binary")).alias("intro_md5"), F.md5(text.excerpt_references(b).cast("binary")).alias("refs_md5"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 500")
def doc_min_text(t):
    return t.documents.where(text.long_enough(F.col("text"))).select("doc_id")


#: Fronts that each rule of the cascade matches, by turns.
FRONTS = """
SELECT doc_id, concat(CASE CAST(doc_id % 10 AS INT)
  WHEN 0 THEN 'Copyright 2011 by us' WHEN 1 THEN 'First published in spring of 2012' WHEN 2 THEN 'Accepted March 2013'
  WHEN 3 THEN 'Vol. 74, No. 3 (2018)' WHEN 4 THEN 'Summer 1999' WHEN 5 THEN 'Q3 2004' WHEN 6 THEN 'May 1987' WHEN 7 THEN 'the crisis of 1992'
  WHEN 8 THEN 'copyright 1975, received 2001' ELSE 'nothing' END, '. ', text) AS front FROM {documents}
"""
_Y = "(19[89][0-9]|20[012][0-9])"
_RULES = [f"©\\s*(?:copyright\\s+)?{_Y}", f"copyright\\s*(?:©\\s*)?{_Y}", f"first\\s+published[^\\n]{{0,40}}{_Y}", f"(?:published|issued|released|appeared|publication\\s+date|print\\s+edition|online\\s+edition|first\\s+online|received|accepted|revised|submitted)[^\\n]{{0,30}}?(?:(?:january|february|march|april|may|june|july|august|september|october|november|december)\\s+)?{_Y}", f"vol(?:\\.|ume)?\\s*[0-9]+[^\\n]{{0,5}}?(?:no\\.?|number|issue|iss\\.?)\\s*[0-9]+[^\\n]{{0,40}}?{_Y}", f"\\b(?:winter|spring|summer|fall|autumn)\\s+{_Y}", f"\\bq[1-4]\\s+{_Y}"]
_FRONT = ", ".join([*(f"TRY_CAST(nullif(regexp_extract(substr(front, 1, 3000), '{r}', 1, 'i'), '') AS INT)" for r in _RULES), f"TRY_CAST(nullif(regexp_extract(substr(front, 1, 400), '\\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\\s+{_Y}', 1, 'i'), '') AS INT)"])


@query(f"WITH f AS ({FRONTS}) SELECT doc_id, coalesce({_FRONT}) AS year FROM f")
def doc_frontmatter_year(t):
    return t.view(FRONTS).select("doc_id", text.frontmatter_year(F.col("front")).alias("year"))


_STAMPS = "SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'none' ELSE concat('D:', CAST(1970 + n_chars % 70 AS {string}), '0102030405') END AS stamp FROM {documents}"


@query(f"WITH s AS ({_STAMPS.replace('{string}', 'VARCHAR')}) SELECT doc_id, CASE WHEN starts_with(stamp, 'D:') AND TRY_CAST(substr(stamp, 3, 4) AS INT) BETWEEN 1990 AND 2027 THEN TRY_CAST(substr(stamp, 3, 4) AS INT) END AS year FROM s")
def doc_metadata_year(t):
    return t.view(_STAMPS.replace("{string}", "STRING")).select("doc_id", text.metadata_year(F.col("stamp"), 2026).alias("year"))


@query("SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y < 2000 THEN 'pre_2000' WHEN y < 2010 THEN '2000_2009' WHEN y < 2020 THEN '2010_2019' ELSE '2020_plus' END AS year_bin, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1")
def doc_year_bin(t):
    return t.orders.groupBy(text.year_bin(F.year("o_orderdate")).alias("year_bin")).agg(F.count("*").alias("n"))


EDGES = [0, 10, 25, 50, 100, 150, 200, 300, 400, 600, 1000]


@query(_D + f"SELECT CAST(CASE {' '.join(f'WHEN wpp >= {e} THEN {e}' for e in reversed(EDGES))} END AS INT) AS bin, count(*) AS n FROM (SELECT {_WORDS} / greatest(pages, 1) AS wpp FROM d) GROUP BY 1")
def doc_wpp_hist(t):
    wpp = text.words_per_page(text.word_count(F.col("body")), F.col("pages"))
    return papers(t).select(wpp.alias("wpp")).groupBy(text.histogram_bin(F.col("wpp"), EDGES).alias("bin")).agg(F.count("*").alias("n"))


@query(_D + "SELECT doc_id, CASE WHEN pages = 0 THEN -1 ELSE pages END AS pages, CASE WHEN pages = 0 THEN -1 ELSE length(body) END AS chars, CASE WHEN pages = 0 THEN 'no pages' END AS error FROM d")
def doc_error_row(t):
    """Documents that could not be read keep a row of -1."""
    failed = F.when(F.col("pages") == 0, "no pages")
    counts = {"pages": F.col("pages"), "chars": F.length("body")}
    return papers(t).select("doc_id", *(c.alias(n) for n, c in text.or_error_row(counts, failed).items()))


@query("SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def doc_raw_markers(t):
    """Counts of markers in raw bytes."""
    paragraphs, links = names.marker_counts(F.encode("html", "UTF-8"), ("<p>", "<a "))
    return t.pages.select("page_id", paragraphs.alias("paragraphs"), links.alias("links"))


_FILES = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('%PDF-1.4', html) WHEN page_id % 3 = 1 THEN concat('junk%PDF-', html) ELSE html END AS content FROM {pages}"


@query(f"WITH f AS ({_FILES}) SELECT page_id, starts_with(content, '%PDF') AS starts, contains(substr(content, 1, 10), '%PDF') AS near, starts_with(content, '%PDF-') AND strlen(content) >= 5000 AS sound FROM f")
def doc_is_pdf(t):
    return t.view(_FILES).select("page_id", *(c.alias(n) for n, c in names.pdf_checks(F.col("content").cast("binary")).items()))


@query(_D + "SELECT doc_id FROM d WHERE coalesce(nullif(pages, 0), 999) >= 6")
def doc_min_pages(t):
    return papers(t).where(names.enough_pages(F.nullif("pages", F.lit(0)))).select("doc_id")


#: Words of the fixtures' invented language, in place of a domain vocabulary.
VOCABULARY = ("this", "that", "with", "from", "have", "dans", "pour", "der", "und", "para")
_HITS = " + ".join(f"CAST(contains(h, '{w}') AS INT)" for w in VOCABULARY)
_VOCAB = rf"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), h AS (SELECT doc_id, len(w) AS n, array_to_string(w[1:1500], ' ') AS h FROM d) "


@query(_VOCAB + f"SELECT doc_id, {_HITS} AS hits, n >= 20 AND {_HITS} >= 3 AS keep FROM h")
def doc_finance_vocab(t):
    d = t.documents.select("doc_id", text.word_count(F.col("text")).alias("n"), text.vocabulary_hits(F.col("text"), VOCABULARY).alias("hits"))
    return d.select("doc_id", "hits", ((F.col("n") >= 20) & (F.col("hits") >= 3)).alias("keep"))


@query(_VOCAB + f"SELECT doc_id, CASE WHEN n < 20 THEN 'junk_zero_text' WHEN {_HITS} < 3 THEN 'junk_low_finance' ELSE 'keep' END AS verdict FROM h")
def doc_vocab_verdict(t):
    verdict = text.vocabulary_verdict(text.word_count(F.col("text")), text.vocabulary_hits(F.col("text"), VOCABULARY), F.lit(False))
    return t.documents.select("doc_id", verdict.alias("verdict"))


@query(r"SELECT page_id FROM pages WHERE NOT (contains(lower(url), 'spam') OR regexp_matches(lower(url), '\?page=[0-9]+') OR regexp_matches(lower(url), '#top$'))")
def doc_junk_name(t):
    """Addresses as names: fragments, then patterns."""
    rules = names.JunkRules(fragments=("spam",), patterns={"page": r"\?page=[0-9]+", "top": "#top$"})
    # The whole address stands for the stem.
    return t.pages.where(names.junk(F.translate("url", "/.", "__"), rules).isNull()).select("page_id")


#: Invented names of files: some of each tier, some of two, and endings, folders and capitals.
_NAMED = """SELECT p_partkey, CASE CAST(p_partkey % 11 AS INT) WHEN 0 THEN concat('/a/', p_name, '.pdf') WHEN 1 THEN 'b/Cover.PDF' WHEN 2 THEN concat('b/lunch menu ', p_partkey, '.pdf') WHEN 3 THEN concat('3.b-', p_name, '.pdf') WHEN 4 THEN concat(p_name, '_kp-', p_partkey % 90, '.pdf')
  WHEN 5 THEN concat('c.d/', p_brand, '.minutes.of.may.pdf') WHEN 6 THEN concat('menus/', p_name) WHEN 7 THEN 'x/.pdf' WHEN 8 THEN concat('lunchbox-', p_partkey, '.txt') WHEN 9 THEN NULL ELSE concat('x/', p_type, '/') END AS path FROM {part}"""
JUNK = names.JunkRules(stems=("cover", "back cover", ".pdf"), fragments=("lunch", "lunch menu", "minutes", "menus", "seating plan"), patterns={"session": r"^\d+\.[a-z][-.]", "product": r"[-_](kp|qr)([-_]\d+)?$"})
_STEM = r"lower(regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1'))"
_FRAGMENT = "regexp_extract(s, '(lunch menu|lunch|minutes|menus|seating plan)', 1)"


@query(rf"""WITH p AS ({_NAMED}), s AS (SELECT p_partkey, {_STEM} AS s FROM p) SELECT p_partkey, CASE WHEN s IN ('cover', 'back cover', '.pdf') THEN 'stem' WHEN {_FRAGMENT} <> '' THEN 'fragment' WHEN regexp_matches(s, '^\d+\.[a-z][-.]') OR regexp_matches(s, '[-_](kp|qr)([-_]\d+)?$') THEN 'pattern' END AS tier,
  CASE WHEN s IN ('cover', 'back cover', '.pdf') THEN s WHEN {_FRAGMENT} <> '' THEN {_FRAGMENT} WHEN regexp_matches(s, '^\d+\.[a-z][-.]') THEN 'session' WHEN regexp_matches(s, '[-_](kp|qr)([-_]\d+)?$') THEN 'product' END AS hit FROM s""")
def doc_junk_tier(t):
    """Which tier of the rules judges a name to be no document's, and what it found."""
    return t.view(_NAMED).select("p_partkey", names.junk(F.col("path"), JUNK).alias("j")).select("p_partkey", "j.tier", "j.hit")


@query("SELECT page_id FROM pages WHERE NOT (starts_with(url, 'http://blog') OR starts_with(url, 'https://blog'))")
def doc_chapter_dup(t):
    return t.pages.where(~names.has_prefix(F.col("url"), ("http://blog", "https://blog"))).select("page_id")


@query("SELECT doc_id, array_to_string(w, ' ') AS abstract FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents)")
def doc_abstract(t):
    """Texts as inverted indexes (word to places), and back. Only texts are shuffled, once each: their words are taken apart where both groupings happen."""
    whole = t.documents.select("doc_id", F.translate("text", "\n", " ").alias("text")).withColumn("row", F.monotonically_increasing_id()).repartition("row")
    w = F.filter(F.split("text", " "), lambda x: x != "")
    placed = whole.select("row", "doc_id", F.posexplode_outer(w).alias("at", "word"))
    index = placed.groupBy("row", "doc_id", "word").agg(F.collect_list("at").alias("places")).groupBy("row", "doc_id")
    entries = F.filter(F.collect_list(F.struct("word", "places")), lambda e: e["word"].isNotNull())
    return index.agg(F.map_from_entries(entries).alias("index")).select("doc_id", text.abstract(F.col("index")).alias("abstract"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_totalprice) AS top_concept, list(o_orderpriority ORDER BY o_totalprice DESC) AS all_concepts FROM orders GROUP BY 1")
def doc_top_concept(t):
    """The names of an array of (score, name), highest score first."""
    by = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("display_name"))).alias("c"))
    ordered = flatten.by_score(F.col("c"))
    return by.select("o_custkey", F.get(ordered, F.lit(0)).alias("top_concept"), ordered.alias("all_concepts"))


@query(_D + "SELECT substr(sha256(text), 1, 12) AS content_id, count(*) AS n FROM d GROUP BY 1")
def doc_content_id(t):
    return t.documents.groupBy(normalise.content_id(F.col("text").cast("binary")).alias("content_id")).agg(F.count("*").alias("n"))
