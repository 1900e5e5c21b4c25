"""Allocation, strata and kappas, overlap regions, name tiers and reports against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, html, link, names, resolve


def plain_shares(rows, n):
    total = sum(rows.values())
    shares = {s: max(1, round(n * r / total)) for s, r in rows.items()}
    over = sum(shares.values()) - n
    while over > 0 and max(shares.values()) > 1:
        largest = min(shares, key=lambda s: (-shares[s], s))
        shares[largest] -= 1
        over -= 1
    return shares


@pytest.mark.parametrize("seed", range(6))
def test_allocation_equals_one_by_one_trimming(spark, seed):
    rnd = random.Random(seed)
    rows = {f"s{i:02d}": rnd.choice([1, 1, 1, 2, 3, 40, 41, 300]) for i in range(rnd.randrange(1, 30))}
    strata = spark.createDataFrame(list(rows.items()), "stratum string, rows long")
    for n in (1, 3, 17, 60, 10_000):
        assert {r.stratum: r["take"] for r in audit.allocate(strata, n).collect()} == plain_shares(rows, n)


def test_allocation_needs_no_list_of_strata(spark):
    strata = spark.range(200_000).select(F.concat(F.lit("s"), "id").alias("stratum"), (1 + F.col("id") % 5).alias("rows"))
    got = audit.allocate(strata, 250_000).agg(F.sum("take").alias("n"), F.min("take").alias("low"), F.max("take").alias("high")).first()
    assert (got.n, got.low) == (250_000, 1) and got.high == 2
    assert audit.allocate(strata.where("id < 0"), 5).count() == 0


def kappa(pairs):
    n = len(pairs)
    if n < 5:
        return None
    po = sum(a == b for a, b in pairs) / n
    pe = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in {x for p in pairs for x in p}) / n / n
    return (1.0 if po == 1 else None) if abs(1 - pe) < 1e-9 else pytest.approx((po - pe) / (1 - pe))


def test_strata_in_one_pass(spark):
    rnd = random.Random(2)
    rows = [(i % 30, rnd.choice(["a", "b", None]), rnd.choice([True, False, None]), rnd.choice(["llm", "llm", "fn_blank"]), rnd.choice(["correct", "wrong_identification", "hallucinated", "human_found", " ", None]), rnd.choice(["x", "y", None]), rnd.choice(["x", "y", "z", "", None])) for i in range(300)]
    rows += [(99, "c", None, "llm", "correct", "x", "x")] * 5 + [(98, "d", None, "llm", "correct", "x", "x")] * 4
    d = spark.createDataFrame(rows, "doc_id int, s string, t boolean, row_type string, human_verdict string, f string, human_f string")
    out = audit.by_strata(d, ("s", "t"), {"f": ("f", "human_f")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Expand" in plan
    got = {r.stratum: r for r in out.collect()}
    text = lambda v: "nan" if v is None else str(v).lower() if isinstance(v, bool) else v
    groups = {"OVERALL": rows} | {f"s={text(v)}": [r for r in rows if r[1] == v] for v in {r[1] for r in rows}} | {f"t={text(v)}": [r for r in rows if r[2] == v] for v in {r[2] for r in rows}}
    assert set(got) == set(groups)
    for name, own in groups.items():
        judged = [r for r in own if r[3] == "llm" and r[4] in ("correct", "wrong_identification")]
        r = got[name]
        assert r.n_docs == len({x[0] for x in own}) and r.n_llm_audited == sum(x[3] == "llm" and bool((x[4] or "").strip()) for x in own)
        assert r.f_accuracy == pytest.approx(sum(not x[6] for x in judged) / len(judged))
        assert r.f_kappa == kappa([(text(x[5]), x[6]) for x in judged if x[6]])


def test_overlap_regions(spark):
    rows = [(2000, 2003, 2001), (2000, 2004, 2001), (None, 2000, 2000), (None, None, None), (1999, 1999, 1999)]
    d = spark.createDataFrame(rows, "a int, b int, c int")
    regions = resolve.overlap(d, ("a", "b", "c"), 3)
    assert {(r.present, r.close): r.n for r in regions.collect()} == {(7, 7): 2, (7, 6): 1, (6, 4): 1, (0, 0): 1}
    assert resolve.overlap_report(regions, ("a", "b", "c")).first().asDict() == {"all_present": 3, "a_b": 2, "a_c": 3, "b_c": 3}
    assert resolve.overlap_report(resolve.overlap(d.limit(0), ("a", "b", "c")), ("a", "b", "c")).first().asDict() == {"all_present": 0, "a_b": 0, "a_c": 0, "b_c": 0}


def test_disagreeing_venues(spark):
    rows = [("x", True, False), ("x", False, True), ("y", True, False), ("y", True, True), ("z", True, None), (None, True, False), ("a", False, True)]
    d = spark.createDataFrame(rows, "v string, code boolean, llm boolean")
    assert [tuple(r) for r in resolve.disagreeing(d, "code", "llm", "v", 2).collect()] == [("x", 2), ("a", 1)]


def test_trie_pattern_finds_the_longest(spark):
    some = ("lunch", "lunch menu", "a.b", "a+", "menus", "m")
    d = spark.createDataFrame([(t,) for t in ("the lunch menus", "xa.bx", "xaXb", "aa+", "none of it", "m", "")], "t string")
    assert [r[0] for r in d.select(F.regexp_extract("t", names.any_of(some), 0)).collect()] == ["lunch menu", "a.b", "", "a+", "", "m", ""]


def test_tiers_of_names(spark):
    rules = names.JunkRules(("Cover",), ("menu", "lunch"), {"number": r"^\d+$", "kp": "_kp$"})
    paths = ["/a/COVER.pdf", "x/lunch-menu.pdf", "x/12.pdf", "a_kp.tar.gz", "a_kp.pdf", "menu/paper.pdf", ".pdf", None, "", "x/"]
    got = [r.j for r in spark.createDataFrame([(p,) for p in paths], "p string").select(names.junk(F.col("p"), rules).alias("j")).collect()]
    assert [tuple(j) if j else None for j in got] == [("stem", "cover"), ("fragment", "lunch"), ("pattern", "number"), None, ("pattern", "kp"), None, None, None, None, None]
    assert spark.range(1).select(names.junk(F.lit("x"), names.JunkRules()).isNull()).first()[0]


def test_rules_by_fragments(spark):
    d = spark.createDataFrame([("Acme papers",), ("Other",), (None,)], "s string")
    c = F.col("s")
    got = d.select(names.first_fragment(c, (("acme", "fund"), ("papers", "paper")), "none"), names.lookup(c, {"Other": "o"}, "d"), names.has_prefix(c, ("acme",)), names.has_topic([c, F.lit("x")], ("papers",)), names.enough_pages(F.lit(None).cast("int"))).collect()
    assert [tuple(r) for r in got] == [("fund", "d", True, True, True), ("none", "o", False, False, True), ("none", "d", False, False, True)]
    hrefs = spark.createDataFrame([("a:::b",), ("a%3A%3a%3Ab",), ("a::b",), (None,)], "h string")
    assert [r[0] for r in hrefs.select(names.malformed(F.col("h"))).collect()] == [True, True, False, False]


def test_report_of_links(spark):
    rows = [(i, "true" if i % 5 else "false", f"t{i}" if i % 4 else None, 2000, "fuzzy_composite" if i % 3 == 0 else "unmatched" if i % 3 == 1 else "low_confidence", i % 3 == 0, 90.0 + i % 7 if i % 3 == 0 else None, i % 6 == 0, f"W{i % 2}", "J" if i % 2 else "K", i % 10) for i in range(60)]
    d = spark.createDataFrame(rows, "row_id int, is_academic string, recovered_title string, recovered_year int, match_method string, in_benchmark boolean, match_score double, doi_confirmed boolean, paper_cluster_id string, bench_journal string, bench_cited_by int")
    got = {}
    for r in link.report(d, 3).collect():
        got.setdefault(r.section, []).append((r.place, r.label, r.value))
    matched = [x for x in rows if x[1] == "true" and x[5]]
    assert sorted(got["papers"]) == [(k + 1, x[2], x[10]) for k, x in enumerate(sorted(matched, key=lambda x: (-x[10], x[0]))[:3])]
    assert sorted(got["unmatched"]) == [(k + 1, x[2], 2000.0) for k, x in enumerate([x for x in rows if x[1] == "true" and x[4] == "unmatched" and x[2]][:3])]
    assert {a: b for _, a, b in got["journals"]} == {j: sum(x[9] == j for x in matched) for j in "JK"}
    scores = [x[6] for x in matched]
    assert dict((a, b) for _, a, b in got["scores"])["mean"] == round(sum(scores) / len(scores), 1) and len(got["scores"]) == 8
    assert sum(r.section == "counts" for r in link.report(d.limit(0)).collect()) == 10


def test_archived_names(spark):
    urls = ["http://a.org/x/p.PDF?q", "http://a.org/x/y/", "http://a.org", "https://a.org/a:b.pdf#p", None]
    d = spark.createDataFrame([("timestamp", "original"), *(("2020", u) for u in urls), (None, "http://a.org/z.pdf")], "timestamp string, original string")
    assert [r.name for r in html.archive_rows(d, "b/").collect()] == ["p.PDF", "_x_y_.pdf", ".pdf", "a_b.pdf", None, "z.pdf"]


def test_issues(spark):
    new = '<a href="/0">before</a><h2>Original Articles</h2><a href="/1">One</a><a href="">none</a><h2>News</h2><a href="/2">Two</a>'
    old = '<a href="/3">Three</a><a href="/4">Executive Summaries</a>'
    d = spark.createDataFrame([(new,), (old,), ("",), (None,)], "h string")
    assert [[x.href for x in r[0]] for r in d.select(html.articles(html.issue_links(F.col("h")))).collect()] == [["/1"], ["/3"], [], []]
