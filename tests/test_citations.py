import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import normalise, text
from tessera.operators import audit, link, merge, patterns, resolve, venues

CITE = "row_id long, doc_id string, recovered_title string, recovered_authors string, recovered_year int, is_academic string, confidence string, doi_candidates string"
BENCH = "bench_row long, openalex_id string, doi string, title string, year int, journal string, cited_by_count int, author_lastnames string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_venue_quirks(spark):
    assert one(spark, normalise.venue(F.lit("Casino Royale"))) == "casi"
    assert one(spark, normalise.venue(F.lit("S&P Dow Jones Indices"))) == "sandp dow jones indices"
    assert one(spark, normalise.venue(F.lit("The Journal (A), Vol. 3"))) == "journal"
    assert one(spark, normalise.venue(F.lit("--"))) is None


def test_authors_in_three_forms(spark):
    for written in ('["Fama", "French"]', "['Fama', 'French']", "Fama; French"):
        assert one(spark, normalise.first_author(F.lit(written))) == "fama"


def test_truncation_at_the_limit(spark):
    long = "a" * 60_001
    assert one(spark, text.strategy(F.lit(long[:-1]), F.lit(True))) == "full"
    assert one(spark, text.strategy(F.lit(long), F.lit(True))) == "first+last"
    assert one(spark, text.strategy(F.lit(long + "\nReferences\nx"), F.lit(True))) == "refs@60002"
    assert one(spark, text.strategy(F.lit(long + "\nReferences\nx"), F.lit(False))) == "first+last"


def test_quality_at_fifty_words(spark):
    q = lambda w: one(spark, text.extraction_quality(F.lit(w), F.lit(10), F.lit(False)))
    assert q(499) == "likely_scanned" and q(500) == "native_text"


def test_one_decimal_is_that_of_the_binary_value(spark):
    values = [w / p for w in range(400) for p in (1, 3, 4, 7, 20, 36, 40)] + [0.25, 0.75, 0.05, 1e-9, 9.95, 49.95, 123456.85, 2.0**-8]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(text.one_decimal(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [f"{v:.1f}" for v in values]


def test_white_space_as_python_has_it(spark):
    assert one(spark, text.word_count(F.lit("a b c\x1cd\u0085e"))) == 5
    rule = patterns.Rule("x", r"\bprice\s+factor\b")
    docs = spark.createDataFrame([(1, "a price factor, PRICE factor")], "doc_id int, text string")
    assert [(r.n, r.context) for r in patterns.scan(docs, [rule]).collect()] == [(2, "a price factor, PRICE factor")]


def test_classes_of_ascii(spark):
    # Before an accent a word ends for ASCII, not for Unicode; the first match's characters may stand in a longer word before it.
    docs = spark.createDataFrame([(1, "undécor des und der. Unddieu und die"), (2, "dans\u00e9 les dansons les, dans les"), (3, "a und \u00fcber die"), (4, "zund die mit und die.")], "doc_id int, text string")
    rules = [patterns.Rule("u", r"\bund\b"), patterns.Rule("d", r"\bdans\b[^.]{0,9}?\bles\b"), patterns.Rule("p", r"\bund\s+d(?:er|ie)\b")]
    got = lambda **how: {(r.doc_id, r.pattern_id): (r.n, r.context) for r in patterns.scan(docs, rules, reach=4, **how).collect()}
    assert {k: v[0] for k, v in got().items()} == {(1, "u"): 2, (1, "p"): 2, (2, "d"): 1, (3, "u"): 1, (4, "u"): 1, (4, "p"): 1}
    plain = got(ascii_classes=True)
    assert {k: v[0] for k, v in plain.items()} == {(1, "u"): 3, (1, "p"): 2, (2, "d"): 2, (3, "u"): 1, (4, "u"): 1, (4, "p"): 1}
    assert plain[2, "d"] == (2, "dans\u00e9 les dan") and plain[4, "p"] == (1, "zund die mit") and got()[4, "p"] == (1, "mit und die.")


def test_odd_letters_and_spaces_as_in_sql(spark):
    import duckdb

    from tessera.plans import citations

    # Dotless and dotted i, long s, Kelvin sign, spaces that aren't ASCII's, at the ends of a context and within.
    texts = ["rat\u0131on des", "a rat\u0130on und der", "th\u0131ng of", "\u00e9rations x, ration\u017fx thing", "ration\u212a b", "dan\u017f le\u017f", "und d\u0131e", "\u00a0und die\u2003", "und der\u3000", "dans\u0131 les", "dans \u0131\u0130 les", "ration\u00e9 x", None]
    rows = [(i, x, f"s{i % 3}") for i, x in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = patterns.scan(docs, citations.RULES, ascii_classes=True).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(plans.oracle_sql()["canon_scan"]).fetchall())
    # Classes, negated ones and groups' marks.
    for regex in (r"x[a-k]z", r"x[^i]z", r"x[hi]z", r"(?:xI)z", r"x\wz", r"x\Wz", r"x[\w-]z"):
        words = [f"x{c}z" for c in "iI\u0131\u0130\u017f\u212aq-"]
        want = [con.execute("SELECT regexp_matches(?, ?, 'i')", [w, regex]).fetchone()[0] for w in words]
        assert list(spark.range(1).select(*(F.lit(w).rlike(patterns._java(regex, True)) for w in words)).first()) == want, regex


def test_rules_are_checked():
    for bad in ([], [patterns.Rule("", "x")], [patterns.Rule("a", "x"), patterns.Rule("a", "y")], [patterns.Rule("a", "(")], [patterns.Rule("a", "x", "other")]):
        with pytest.raises(ValueError):
            patterns.check(bad)
    assert patterns.next_version("2.1") == "2.2"


def test_venue_cascade(spark):
    cfg = venues.Venues(academic=("Journal of A",), practitioner=("B",), aliases={"JA": "Journal of A"}, ambiguous=("C",), working_paper=("nber",))
    d = spark.createDataFrame([("JA",), ("b",), ("C",), ("NBER 12",), ("?x",), (None,)], "recovered_journal string")
    got = [(r.is_academic_code, r.venue_reason) for r in venues.classify(d, cfg).collect()]
    assert got == [(True, "academic"), (False, "practitioner"), (None, "ambiguous"), (None, "working_paper"), (None, "unknown"), (None, None)]


def test_disagreeing_rows_may_stand_for_many(spark):
    d = spark.createDataFrame([("a", True, False, 3), ("a", True, True, 9), ("b", False, True, 2), ("b", False, True, 2), (None, True, False, 8), ("c", None, True, 7)], "v string, code boolean, llm boolean, k long")
    assert [tuple(r) for r in resolve.disagreeing(d, "code", "llm", "v", rows="k").collect()] == [("b", 4), ("a", 3)]
    assert [tuple(r) for r in resolve.disagreeing(d, "code", "llm", "v").collect()] == [("b", 2), ("a", 1)]


def test_abstracts_shuffle_texts_alone(spark):
    plan = plans.queries()["doc_abstract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_resolution_order(spark):
    d = spark.createDataFrame([(True, False, True), (None, False, True), (None, True, False), (None, False, False), (None, None, None)], "code boolean, llm boolean, hedge boolean")
    value, source = resolve.canonical(F.col("code"), F.col("llm"), F.col("hedge"))
    assert [tuple(r) for r in d.select(value, source).collect()] == [(True, "code"), (True, "structural_uncertain"), (True, "llm"), (False, "llm"), (None, "none")]
    value, source = resolve.year(F.lit(1990), F.lit(1991), F.lit(1992), F.lit(1993))
    assert tuple(spark.range(1).select(value, source).first()) == (1990, "path")


def test_merge_takes_first_match_and_last_row(spark):
    llm = spark.createDataFrame([(1, "d", "A title of note", "['X']", 1990), (2, "d", "A title of note", "['X']", 1990)], "row_id long, doc_id string, recovered_title string, recovered_authors string, recovered_year int")
    canon = spark.createDataFrame([(1, "d", "A title of note", "X", 1990, 3, "p1"), (2, "d", "a title of notes", "X", 1990, 5, "p2"), (3, "e", "Other", "X", 1990, 1, "p3")], "row_id long, doc_id string, recovered_title string, recovered_authors string, recovered_year int, within_doc_mention_count int, canonical_pattern_id string")
    docs = spark.createDataFrame([("d", "T")], "doc_id string, source_title string")
    rows = {(r.citation_source, r.row_id): r for r in merge.merge(llm, canon, docs, ["p3"]).collect()}
    assert rows["llm", 1].within_doc_mention_count == 5 and rows["llm", 1].canonical_pattern_id == "p2"
    assert rows["llm", 2].canonical_pattern_id is None
    assert rows["mechanical_canonical", 3].likely_metric_only and len(rows) == 3


def papers(spark, rows):
    return spark.createDataFrame([(i, f"W{i}", f"https://doi.org/10.1/{i}", t, y, "J", 1, '["Doe"]') for i, (t, y) in enumerate(rows)], BENCH)


def test_link_walks_to_the_first_fitting_year(spark):
    title = "an analysis of things that matter"
    bench = papers(spark, [(title, 1950), (title + "s", 1990)] + [("unlike " * 5, 1990)])
    cites = spark.createDataFrame([(1, "d", title, "Doe, J.", 1991, "true", None, '["10.1/1"]'), (2, "d", title, "Doe, J.", None, "true", "high", None), (3, "d", title, "Doe", 1991, "true", "low", None), (4, "d", title, "Doe", 1991, "false", "high", None)], CITE)
    got = {r.row_id: r for r in link.link(cites, bench).collect()}
    assert len(got) == 4
    assert got[1].benchmark_openalex_id == "W1" and got[1].doi_confirmed and got[1].paper_cluster_id == "W1"
    assert got[2].match_method == "unmatched" and got[2].paper_cluster_id.startswith("unmatched_")
    assert got[3].match_method == "low_confidence" and got[4].match_method == "not_academic" and got[4].paper_cluster_id is None


def test_link_stops_at_rank_five(spark):
    title = "an analysis of things that matter"
    bench = papers(spark, [(title, 1950)] * 5 + [(title, 1990)])
    cites = spark.createDataFrame([(1, "d", title, "Doe", 1990, "true", None, None)], CITE)
    assert link.link(cites, bench).first().match_method == "unmatched"


def joined_rows(plan):
    """The most rows that a join of the plan, which has run, gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return joined_rows(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    return max([own] + [joined_rows(plan.children().apply(i)) for i in range(plan.children().size())])


def test_rows_of_equal_keys_do_not_meet_as_pairs(spark):
    title = "an analysis of things that matter"
    bench = papers(spark, [(title, 1950)] * 4 + [(title, 1990)] * 66 + [("unlike " * 5, 1990)])
    cites = spark.createDataFrame([(i, "d", title, "Doe", 1990 if i % 2 else 1951, "true", None, None) for i in range(60)], CITE)
    found = link.stage_b(link.citation_keys(cites), link.benchmark_keys(bench))
    assert {r.row_id: (r.bench_row, r.match_score) for r in found.collect()} == {i: (4 if i % 2 else 0, 100.0) for i in range(60)}
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= 60 * 5


def test_document_dois_are_those_of_the_first_row(spark):
    cites = spark.createDataFrame([(1, "d", None, None, None, "true", None, None), (2, "d", None, None, None, "true", None, '["10.1/1"]')], CITE)
    assert link.document_dois(cites).first().dois == []


def test_kappa(spark):
    same = spark.createDataFrame([(1, "true", "true")] * 3, "doc_id int, a string, b string")
    assert audit.agreement(audit.pairs(same, {"f": ("a", "b")})).first().kappa is None
    assert audit.kappa_multi(same, "a", "b").first().kappa == 1.0


def test_samples_have_their_sizes(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, "a").when(F.col("id") < 199, "b").alias("s"))
    got = [tuple(r) for r in audit.stratified(d, 20, "s", "doc_id").groupBy("s").count().orderBy("s").collect()]
    assert got == [(None, 1), ("a", 14), ("b", 5)]
    assert audit.stratified(d, 500, "s", "doc_id").count() == 200
