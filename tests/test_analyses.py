"""Divergence, ages, hazards and shares against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import citation_age, divergence


def test_measures_equal_plain(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", "z", "w", None])) for _ in range(200)] + [("lonely", "only"), ("same", "x")]
    vectors = divergence.frequencies(spark.createDataFrame(rows, "g string, w string"), F.col("g"), F.col("w"))
    plain = {}
    for g, w in rows:
        if g is not None and w is not None:
            plain.setdefault(g, Counter())[w] += 1
    got = {(r.a, r.b): r for r in divergence.measures(vectors).collect()}
    assert set(got) == {(a, b) for a in plain for b in plain if a < b}
    for (a, b), r in got.items():
        x, y = plain[a], plain[b]
        shared = len(x.keys() & y.keys())
        dot = sum(x[w] * y[w] for w in x)
        assert r.shared == shared and r.overlap == pytest.approx(shared / min(len(x), len(y))) and r.jaccard == pytest.approx(shared / len(x.keys() | y.keys()))
        assert r.cosine == pytest.approx(dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))


def test_hazard_equals_plain(spark):
    rnd = random.Random(4)
    papers = [(i, rnd.randrange(1990, 2004)) for i in range(60)] + [(None, 1990), (99, None), (100, 2030)]
    cites = [(rnd.randrange(70), rnd.randrange(1985, 2012)) for _ in range(80)] + [(None, 2000), (3, None)]
    got = citation_age.first_citation_hazard(spark.createDataFrame(papers, "paper_id int, paper_year int"), spark.createDataFrame(cites, "paper_id int, cited_year int"), 2008).orderBy("age").collect()
    spans = []
    for i, y in papers:
        if i is None or y is None or y > 2008:
            continue
        years = [c for p, c in cites if p == i and c is not None and y <= c <= 2008]
        spans.append((min(years) - y, True) if years else (2008 - y, False))
    kept = 1.0
    assert [r.age for r in got] == sorted({a for a, _ in spans})
    for r in got:
        risk, events = sum(a >= r.age for a, _ in spans), sum(a == r.age and e for a, e in spans)
        kept *= 1 - events / risk
        assert (r.at_risk, r.events) == (risk, events) and r.hazard == pytest.approx(events / risk) and r.survival == pytest.approx(kept)


def test_survival_ends_at_zero(spark):
    papers, cites = spark.createDataFrame([(1, 2000), (2, 2000)], "paper_id int, paper_year int"), spark.createDataFrame([(1, 2001), (2, 2003)], "paper_id int, cited_year int")
    assert [(r.age, r.survival) for r in citation_age.first_citation_hazard(papers, cites, 2010).orderBy("age").collect()] == [(1, 0.5), (3, 0.0)]


def test_ages_leave_out_the_future(spark):
    c = spark.createDataFrame([(2000, 2000), (2000, 2005), (2001, 2000), (None, 2000), (1999, None), (1995, 2000)], "paper_year int, cited_year int")
    assert [(r.age, r.n, r.share, r.cumulative) for r in citation_age.ages(c).orderBy("age").collect()] == [(0, 1, pytest.approx(1 / 3), pytest.approx(1 / 3)), (5, 2, pytest.approx(2 / 3), pytest.approx(1))]


def test_share_without_papers(spark):
    c = spark.createDataFrame([(2000, True), (2000, False), (2001, True), (None, True)], "year int, good boolean")
    v = spark.createDataFrame([(2000, 10)], "year int, papers int")
    got = {r.year: r for r in citation_age.normalised_share(c, v, kept=F.col("good")).collect()}
    assert set(got) == {2000, 2001} and got[2000].share == 0.5 and got[2000].per_paper == pytest.approx(0.1) and got[2000]["index"] == pytest.approx(1)
    assert got[2001].per_paper is None and got[2001]["index"] is None


def test_purity(spark):
    a = spark.createDataFrame([("s", "x"), ("s", "x"), ("s", "y"), ("t", "z"), ("t", None)], "`group` string, author string")
    b = spark.createDataFrame([("x",), ("x",), (None,)], "author string")
    assert {r.group: (r.authors, r.known, r.purity) for r in divergence.purity(a, b).collect()} == {"s": (2, 1, 0.5), "t": (1, 0, 1.0)}
