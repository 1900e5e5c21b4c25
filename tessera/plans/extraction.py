"""Queries of the extractor hook and of nested records."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import functions as F

from ..operators import extract, flatten
from .registry import query

_MENTION = re.compile(r"[A-Z][a-z]+ing\b", re.ASCII)
_MENTIONS = r"list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ing\b'))"


class Rules:
    """A rule-based extractor in place of a model: mentions of words in -ing. With failures, texts ask to be asked again, break their answer, or fail,
    each by its length."""

    def __init__(self, failing: bool = False):
        self.failing, self.asked = failing, {}

    def __call__(self, texts: list[str]) -> list[str]:
        return [self.one(t, len(texts) == 1) for t in texts]

    def one(self, text: str, alone: bool) -> str:
        n = len(text)
        if self.failing:
            if n % 17 == 1:
                raise ValueError("no answer")
            if n % 13 == 1:
                return "```json\n{broken\n```"
            if n % 5 == 1:
                # A text is refused in company, and as many times alone as its length tells.
                name = (n, zlib.crc32(text.encode()))
                self.asked[name] = self.asked.get(name, 0) + alone
                if not alone or self.asked[name] <= n % 7 or n % 7 > 4:
                    raise extract.RateLimited
                del self.asked[name]
        found = list(dict.fromkeys(_MENTION.findall(text)))
        return "```json\n" + json.dumps({"source": {"title": "" if n % 2 else f"title {n}"}, "citations": [{"mention": m.lower(), "words": 1} for m in found]}) + "\n```"


def _found(t, failing: bool):
    docs = t.documents.select("doc_id", "text", "source")
    skip = F.when(F.trim("text") == "", "skipped_no_text")
    found = extract.answers(docs, "doc_id", F.col("text"), Rules(failing), skip, wait=0.0)
    return extract.parsed(found, "title: string", "mention: string, words: int"), docs


@query(rf"SELECT doc_id, source, lower(word) AS mention FROM (SELECT doc_id, source, unnest({_MENTIONS}) AS word FROM documents)")
def doc_llm_extract(t):
    """Citations of the extractor hook beside fields of their document."""
    found, docs = _found(t, False)
    return extract.citation_rows(found, docs, "doc_id", ("source",)).select("doc_id", "source", "mention")


_STATE = "CASE WHEN trim(text) = '' THEN 'skipped_no_text' WHEN n % 17 = 1 THEN 'api_error' WHEN n % 13 = 1 THEN 'json_error' WHEN n % 5 = 1 AND n % 7 > 4 THEN 'max_retries' ELSE 'ok' END"


@query(rf"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT *, {_STATE} AS llm_status FROM d)
  SELECT doc_id, llm_status, CASE WHEN llm_status <> 'skipped_no_text' THEN llm_status = 'ok' END AS json_valid, CASE WHEN llm_status = 'max_retries' THEN 5 WHEN llm_status = 'ok' AND n % 5 = 1 THEN n % 7 ELSE 0 END AS retry_count, CASE WHEN llm_status = 'ok' AND n % 2 = 0 THEN 'title ' || n ELSE 'document ' || doc_id END AS title, CASE WHEN llm_status = 'ok' THEN len({_MENTIONS}) ELSE 0 END AS n_citations FROM s""")
def doc_llm_status(t):
    """One row a document whatever its extractor does: refusals, broken answers and failures are injected."""
    found, _ = _found(t, True)
    return extract.document_rows(found, "doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")))


#: Orders as works: their lines are authors (every fifth without id) and, by price, concepts.
WORKS = """SELECT o_orderkey, to_json(named_struct('id', concat('https://w.org/W', o_orderkey), 'doi', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('https://doi.org/10.1/', o_orderkey) END, 'title', o_orderpriority, 'publication_year', year(o_orderdate),
  'cited_by_count', o_custkey, 'authorships', authorships, 'concepts', concepts, 'abstract_inverted_index', map(o_orderstatus, array(0, 2), 'is', array(1)), 'open_access', named_struct('is_oa', o_orderkey % 2 = 0))) AS work
  FROM (SELECT l_orderkey, sort_array(collect_list(named_struct('line', l_linenumber, 'part', l_partkey, 'supp', l_suppkey, 'author', named_struct('id', CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('https://w.org/A', l_partkey) END, 'display_name', CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE concat('Given Name', l_suppkey) END)))) AS authorships,
    sort_array(collect_list(named_struct('line', l_linenumber, 'part', l_partkey, 'supp', l_suppkey, 'display_name', concat('concept ', l_partkey), 'score', l_discount))) AS concepts FROM {lineitem} GROUP BY l_orderkey) JOIN {orders} ON o_orderkey = l_orderkey"""


def _works(t):
    return t.view(WORKS).select("o_orderkey", F.from_json("work", flatten.WORK).alias("w"))


_LINES = """WITH l AS (SELECT l_orderkey, list(CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'Given Name' || l_suppkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS names, list(CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'Name' || l_suppkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS lasts,
  coalesce(list('A' || l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_partkey % 5 <> 0), []) AS ids, list('concept ' || l_partkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS concepts FROM lineitem GROUP BY 1) """


@query(_LINES + """SELECT 'W' || o_orderkey AS openalex_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://doi.org/10.1/' || o_orderkey END AS doi, o_orderpriority AS title, year(o_orderdate) AS year, 'Journal A' AS journal, o_custkey AS cited_by_count,
  o_orderstatus || ' is ' || o_orderstatus AS abstract, concepts[1] AS top_concept, CAST(to_json(concepts) AS VARCHAR) AS all_concepts, CAST(to_json(names) AS VARCHAR) AS author_names, CAST(to_json(lasts) AS VARCHAR) AS author_lastnames, CAST(to_json(ids) AS VARCHAR) AS author_ids, o_orderkey % 2 = 0 AS is_oa FROM l JOIN orders ON o_orderkey = l_orderkey""")
def src_json_flatten_work(t):
    """Works of three levels as flat rows."""
    columns = flatten.work_columns(F.col("w"), F.lit("Journal A"), "https://w.org/")
    return _works(t).select(*(c.alias(n) for n, c in columns.items()))


@query("""SELECT o_orderkey, 'https://w.org/W' || o_orderkey AS id, year(o_orderdate) AS publication_year, list(CASE WHEN l_suppkey % 6 <> 0 THEN 'Given Name' || l_suppkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS author_name,
  list(CASE WHEN l_partkey % 5 <> 0 THEN 'https://w.org/A' || l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS authorships_author_id, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey) AS concepts_score, o_orderkey % 2 = 0 AS open_access_is_oa FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def src_json_flatten_walk(t):
    """Every leaf under a name made of its path; lists of records are aligned by place."""
    works = _works(t)
    wanted = {"id", "publication_year", "authorships.author.display_name", "authorships.author.id", "concepts.score", "open_access.is_oa"}
    return works.select("o_orderkey", *flatten.flat(F.col("w"), works.schema["w"].dataType, rename={"authorships.author.display_name": "author_name"}, only=wanted.__contains__))
