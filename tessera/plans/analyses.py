"""Queries of the analyses over linked citations: divergence, ages, shares, purity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import citation_age, divergence
from .registry import query

_VECTORS = r"""WITH w AS (SELECT source AS g, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM documents),
  v AS (SELECT g, term, count(*) AS weight FROM w WHERE g IS NOT NULL GROUP BY ALL), n AS (SELECT g, count(*) AS terms, sum(weight) AS total, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS norm FROM v GROUP BY 1) """


def _vectors(t):
    listed = t.documents.select("source", F.explode(words(F.lower("text"))).alias("word"))
    return divergence.frequencies(listed, F.col("source"), F.col("word"))


@query(_VECTORS + "SELECT g AS \"group\", terms, total, round(norm, 6) AS norm FROM n")
def ana_vector_norms(t):
    return divergence.norms(_vectors(t)).select("group", "terms", "total", F.round("norm", 6).alias("norm"))


@query(_VECTORS + """, m AS (SELECT x.g AS a, y.g AS b, count(*) AS shared, sum(CAST(x.weight AS DOUBLE) * y.weight) AS dot FROM v x JOIN v y ON x.term = y.term AND x.g < y.g GROUP BY ALL)
  SELECT p.g AS a, q.g AS b, p.terms AS terms_a, q.terms AS terms_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / least(p.terms, q.terms), 9) AS overlap, round(coalesce(dot, 0) / (p.norm * q.norm), 9) AS cosine,
  round(coalesce(shared, 0) / (p.terms + q.terms - coalesce(shared, 0)), 9) AS jaccard FROM n p JOIN n q ON p.g < q.g LEFT JOIN m ON m.a = p.g AND m.b = q.g""")
def ana_divergence(t):
    """Per pair of sources: overlap coefficient and cosine of word frequencies, Jaccard as a baseline."""
    out = divergence.measures(_vectors(t))
    return out.select("a", "b", "terms_a", "terms_b", "shared", *(F.round(c, 9).alias(c) for c in ("overlap", "cosine", "jaccard")))


#: Customers as papers with a year of their own, their orders as citations.
CITED = "SELECT o_custkey AS paper_id, 1985 + o_custkey % 13 AS paper_year, year(o_orderdate) AS cited_year, o_orderpriority AS channel, o_orderstatus = 'F' AS canonical FROM {orders}"
PUBLISHED = "SELECT c_custkey AS paper_id, CAST(1985 + c_custkey % 13 AS INT) AS paper_year, c_mktsegment AS journal FROM {customer}"
_C, _Q = CITED.replace("{orders}", "orders"), PUBLISHED.replace("{customer}", "customer")


def _cited(t):
    return t.view(CITED).withColumn("paper_year", F.col("paper_year").cast("int"))


@query(f"""WITH c AS ({_C}), a AS (SELECT channel, cited_year - paper_year AS age FROM c WHERE cited_year >= paper_year), n AS (SELECT channel, age, count(*) AS n FROM a GROUP BY ALL)
  SELECT channel, age, n, round(n / sum(n) OVER (PARTITION BY channel), 9) AS share, round(sum(n) OVER (PARTITION BY channel ORDER BY age) / sum(n) OVER (PARTITION BY channel), 9) AS cumulative FROM n""")
def ana_citation_ages(t):
    return citation_age.ages(_cited(t), ("channel",)).select("channel", "age", "n", F.round("share", 9).alias("share"), F.round("cumulative", 9).alias("cumulative"))


@query(f"""WITH c AS ({_C}), p AS ({_Q}), f AS (SELECT p.paper_id, min(cited_year) AS first_year FROM p JOIN c USING (paper_id) WHERE cited_year >= p.paper_year AND cited_year <= 1996 GROUP BY 1),
  s AS (SELECT journal, coalesce(first_year, 1996) - paper_year AS age, first_year IS NOT NULL AS event FROM p LEFT JOIN f USING (paper_id) WHERE paper_year <= 1996),
  l AS (SELECT journal, age, count(*) AS leaving, count(*) FILTER (event) AS events FROM s GROUP BY ALL),
  r AS (SELECT journal, age, events, (SELECT sum(leaving) FROM l k WHERE k.journal = l.journal AND k.age >= l.age) AS at_risk FROM l)
  SELECT journal, age, CAST(at_risk AS BIGINT) AS at_risk, events, round(events / at_risk, 9) AS hazard, round((SELECT product(1 - k.events / k.at_risk) FROM r k WHERE k.journal = r.journal AND k.age <= r.age), 9) AS survival FROM r""")
def ana_first_citation_hazard(t):
    out = citation_age.first_citation_hazard(t.view(PUBLISHED), _cited(t).select("paper_id", "cited_year"), 1996, ("journal",))
    return out.select("journal", "age", "at_risk", "events", F.round("hazard", 9).alias("hazard"), F.round("survival", 9).alias("survival"))


@query(f"""WITH c AS ({_C}), v AS (SELECT year(l_shipdate) AS year, count(*) AS papers FROM lineitem WHERE year(l_shipdate) > 1992 GROUP BY 1), n AS (SELECT channel, cited_year AS year, count(*) AS n, count(*) FILTER (canonical) AS chosen FROM c GROUP BY ALL),
  j AS (SELECT * FROM n LEFT JOIN v USING (year)), o AS (SELECT channel, sum(chosen) FILTER (papers > 0) / sum(papers) AS whole FROM j GROUP BY 1)
  SELECT channel, year, n, chosen, round(chosen / n, 9) AS share, papers, round(chosen / papers, 9) AS per_paper, round(chosen / papers / nullif(whole, 0), 9) AS index FROM j JOIN o USING (channel)""")
def ana_normalised_share(t):
    volumes = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("papers")).where("year > 1992")
    cited = t.view(CITED).withColumnRenamed("cited_year", "year")
    out = citation_age.normalised_share(cited, volumes, ("channel",), F.col("canonical"))
    return out.select("channel", "year", "n", "chosen", F.round("share", 9).alias("share"), "papers", F.round("per_paper", 9).alias("per_paper"), F.round("index", 9).alias("index"))


@query("""WITH o AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS author FROM orders), b AS (SELECT DISTINCT c_custkey AS author FROM customer WHERE c_acctbal > 5000)
  SELECT g AS "group", count(*) AS authors, count(b.author) AS known, round(1 - count(b.author) / count(*), 9) AS purity FROM o LEFT JOIN b USING (author) GROUP BY 1""")
def ana_purity(t):
    authors = t.orders.select(F.col("o_orderpriority").alias("group"), F.col("o_custkey").alias("author"))
    benchmark = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("author"))
    return divergence.purity(authors, benchmark).withColumn("purity", F.round("purity", 9))
