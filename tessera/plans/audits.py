"""Queries on audits, samples, and the aggregate, join, window and set forms of reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit
from .registry import query

#: Two judges of each labelled document, with gaps.
JUDGED = """SELECT l.doc_id, d.source AS source_type, d.lang, CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE l.quality = 1 END AS a_code, CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE l.toxic = 0 END AS a_llm,
  CASE WHEN l.doc_id % 3 = 0 THEN true END AS c_code, l.toxic = 1 AS c_llm, CAST(1990 + d.n_chars % 20 AS INT) AS y_code, CAST(1990 + (d.n_chars + l.doc_id % 6) % 20 AS INT) AS y_llm FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""
FIELDS = {"is_academic": ("a_code", "a_llm"), "is_canonical": ("c_code", "c_llm"), "source_year": ("y_code", "y_llm")}
_P = f"WITH j AS ({JUDGED}), p AS (" + " UNION ALL ".join(f"SELECT doc_id, source_type, lang, '{f}' AS field, CAST({c} AS VARCHAR) AS code_value, CAST({m} AS VARCHAR) AS llm_value FROM j" for f, (c, m) in FIELDS.items()) + ") "


def _pairs(t):
    return audit.pairs(t.view(JUDGED), FIELDS, ("doc_id", "source_type", "lang"))


@query(_P + "SELECT doc_id, field, code_value, llm_value FROM p")
def aud_pairs(t):
    return _pairs(t).select("doc_id", "field", "code_value", "llm_value")


@query(_P + "SELECT doc_id, field, code_value = llm_value AS agree FROM p")
def aud_agree_flag(t):
    return _pairs(t).select("doc_id", "field", "agree")


_AGREE = """SELECT field, count(*) AS total_rows, count(*) FILTER (code_value IS NULL AND llm_value IS NULL) AS both_null, count(*) FILTER (code_value IS NOT NULL AND llm_value IS NULL) AS code_only,
  count(*) FILTER (code_value IS NULL AND llm_value IS NOT NULL) AS llm_only, count(*) FILTER (code_value IS NOT NULL AND llm_value IS NOT NULL) AS both_present, count(*) FILTER (code_value = llm_value) AS agree, count(*) FILTER (code_value <> llm_value) AS disagree,
  count(*) FILTER (code_value = llm_value) / count(*) FILTER (code_value IS NOT NULL AND llm_value IS NOT NULL) AS agreement_rate,
  count(*) FILTER (code_value = 'true' AND llm_value IS NOT NULL) / count(*) FILTER (code_value IS NOT NULL AND llm_value IS NOT NULL) AS pc, count(*) FILTER (llm_value = 'true' AND code_value IS NOT NULL) / count(*) FILTER (code_value IS NOT NULL AND llm_value IS NOT NULL) AS pl FROM p GROUP BY 1"""


@query(_P + f", s AS ({_AGREE}) SELECT field, total_rows, both_null, code_only, llm_only, both_present, agree, disagree, agreement_rate FROM s")
def aud_agreement(t):
    return audit.agreement(_pairs(t)).drop("kappa")


@query(_P + f", s AS ({_AGREE}) SELECT field, round((agreement_rate - pc * pl - (1 - pc) * (1 - pl)) / nullif(1 - pc * pl - (1 - pc) * (1 - pl), 0), 9) AS kappa FROM s WHERE field <> 'source_year'")
def aud_kappa_binary(t):
    return audit.agreement(_pairs(t).where("field <> 'source_year'")).select("field", F.round("kappa", 9).alias("kappa"))


@query(f"""WITH j AS ({JUDGED}), x AS (SELECT y_code AS a, y_llm AS b FROM j), n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM x),
  e AS (SELECT sum(p.k * q.k) AS s FROM (SELECT a AS c, count(*) AS k FROM x GROUP BY 1) p JOIN (SELECT b AS c, count(*) AS k FROM x GROUP BY 1) q USING (c)) SELECT n, round((po - s / (n * n)) / (1 - s / (n * n)), 9) AS kappa FROM n, e""")
def aud_kappa_multi(t):
    return audit.kappa_multi(t.view(JUDGED), "y_code", "y_llm").select("n", F.round("kappa", 9).alias("kappa"))


_TAKEN = """, d AS (SELECT *, coalesce(source_type, '__unknown__') AS stratum FROM p WHERE field = 'is_academic' AND code_value <> llm_value), z AS (SELECT stratum, count(*) AS rows FROM d GROUP BY 1), t AS (SELECT sum(rows) AS total FROM z),
  s AS (SELECT stratum, rows, greatest(1, CAST(round_even({n} * rows / total, 0) AS INT)) AS share FROM z, t), u AS (SELECT stratum, unnest(range(2, share + 1)) AS height FROM s), o AS (SELECT sum(share) - {n} AS over FROM s),
  g AS (SELECT stratum, count(*) AS gone FROM (SELECT stratum, row_number() OVER (ORDER BY height DESC, stratum) AS k FROM u), o WHERE k <= over GROUP BY 1), w AS (SELECT stratum, rows, CAST(share - coalesce(gone, 0) AS INT) AS take FROM s LEFT JOIN g USING (stratum)) """


@query(_P + _TAKEN.format(n=25) + "SELECT stratum, rows, take FROM w")
def aud_allocation(t):
    """Proportional shares of strata, levelled where the floor of one makes them too many."""
    strata = _pairs(t).where("field = 'is_academic' and not agree").groupBy(F.coalesce("source_type", F.lit("__unknown__")).alias("stratum")).agg(F.count("*").alias("rows"))
    return audit.allocate(strata, 25)


@query(_P + _TAKEN.format(n=40) + """, q AS (SELECT d.*, take, row_number() OVER (PARTITION BY d.stratum ORDER BY md5('42|' || doc_id), doc_id) AS place FROM d JOIN w USING (stratum))
  SELECT doc_id, source_type, lang, field, code_value, llm_value, false AS agree FROM q, t WHERE total <= 40 OR place <= take""")
def aud_sample(t):
    return audit.stratified(_pairs(t).where("field = 'is_academic' and not agree"), 40, "source_type", "doc_id", 42)


@query(_P + "SELECT source_type, count(*) AS n FROM p WHERE field = 'is_academic' AND code_value IS NULL GROUP BY 1 ORDER BY n DESC, source_type LIMIT 20")
def aud_coverage_gap(t):
    return _pairs(t).where("field = 'is_academic' and code_value is null").groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type").limit(20)


@query(_P + "SELECT source_type, code_value, llm_value, count(*) AS n FROM p WHERE field = 'is_academic' AND code_value <> llm_value GROUP BY ALL ORDER BY n DESC, source_type, code_value LIMIT 15")
def aud_top_disagree(t):
    return _pairs(t).where("field = 'is_academic' and not agree").groupBy("source_type", "code_value", "llm_value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type", "code_value").limit(15)


@query(f"WITH j AS ({JUDGED}), d AS (SELECT y_code - y_llm AS d FROM j WHERE y_code <> y_llm) SELECT count(*) AS n, avg(d) AS mean, median(d) AS median, count(*) FILTER (abs(d) <= 1) AS near, count(*) FILTER (abs(d) > 3) AS far FROM d")
def aud_year_diff(t):
    d = t.view(JUDGED).where("y_code <> y_llm").select((F.col("y_code") - F.col("y_llm")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.count_if(F.abs("d") <= 1).alias("near"), F.count_if(F.abs("d") > 3).alias("far"))


@query(_P + "SELECT lang, count(*) AS n FROM p WHERE field = 'is_canonical' AND code_value = 'true' AND llm_value = 'false' GROUP BY 1 ORDER BY n DESC, lang LIMIT 10")
def aud_code_true_llm_false(t):
    return _pairs(t).where("field = 'is_canonical' and code_value = 'true' and llm_value = 'false'").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(10)


_LABEL = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'code' WHEN 1 THEN 'llm' WHEN 2 THEN 'both_wrong' ELSE 'ambiguous' END"


@query(_P + f"SELECT field, {_LABEL} AS label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY field) AS share FROM p WHERE code_value <> llm_value GROUP BY 1, 2")
def aud_labeled(t):
    counted = _pairs(t).where("not agree").groupBy("field", F.expr(_LABEL.replace("CAST(doc_id % 4 AS INT)", "doc_id % 4")).alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


_DOCS = "SELECT doc_id, source AS source_type, CASE WHEN n_chars % 11 = 0 THEN 'likely_scanned' ELSE 'native_text' END AS pdf_extraction_method, n_chars % 13 = 0 AS doc_text_truncated, CASE WHEN n_chars % 5 = 0 THEN 'skipped' ELSE 'ok' END AS llm_status FROM {documents}"


_PICK = "SELECT doc_id FROM {rows} ORDER BY md5('{seed}|' || doc_id), doc_id LIMIT {n}"


@query(f"""WITH g AS (SELECT * FROM ({_DOCS.replace('{documents}', 'documents')}) WHERE llm_status = 'ok'), a AS ({_PICK.format(rows="g WHERE pdf_extraction_method = 'likely_scanned'", seed=43, n=5)}),
  b AS ({_PICK.format(rows="g WHERE doc_text_truncated AND doc_id NOT IN (SELECT doc_id FROM a)", seed=44, n=5)}), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
  c AS (SELECT doc_id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY md5('45|' || doc_id), doc_id) AS k FROM g WHERE source_type IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM ab)) WHERE k <= 2),
  abc AS (SELECT doc_id FROM ab UNION ALL SELECT doc_id FROM c), r AS (SELECT *, row_number() OVER (ORDER BY md5('46|' || doc_id), doc_id) AS k FROM g WHERE doc_id NOT IN (SELECT doc_id FROM abc))
  SELECT doc_id, 'oversample_scanned' AS stratum FROM a UNION ALL SELECT doc_id, 'oversample_truncated' FROM b UNION ALL SELECT doc_id, 'src_min_' || source_type FROM c
  UNION ALL SELECT doc_id, 'fill_' || coalesce(source_type, 'unknown') FROM r WHERE k <= 60 - (SELECT count(*) FROM abc)""")
def val_sample(t):
    return audit.review_sample(t.view(_DOCS), 60, 42)


@query("SELECT conv_id AS doc_id, 'llm' AS row_type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM conversations UNION ALL SELECT doc_id, 'fn_blank', unnest(range(1, 11)) FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations)")
def val_template(t):
    return audit.template(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("row_id")))


_AUDITED = """SELECT o_custkey AS doc_id, o_orderstatus AS source_type, CASE WHEN o_orderkey % 6 = 0 THEN 'fn_blank' ELSE 'llm' END AS row_type,
  CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'human_found' WHEN 1 THEN 'wrong_identification' WHEN 2 THEN 'hallucinated' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'correct' END AS human_verdict,
  CASE WHEN o_orderkey % 10 = 1 THEN 'other' ELSE '' END AS human_subfield FROM {orders}"""


def _sql_metrics(stratum: str, group: str) -> str:
    return f"""SELECT {stratum} AS stratum, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (l) AS n_llm_audited, count(*) FILTER (l AND v = 'correct') AS correct, count(*) FILTER (l AND v = 'wrong_identification') AS wrong_id, count(*) FILTER (l AND v = 'hallucinated') AS hallucinated,
      count(*) FILTER (row_type = 'fn_blank' AND v = 'human_found') AS fn_found, count(*) FILTER (j) / count(*) FILTER (j OR (l AND v = 'hallucinated')) AS detection_precision, count(*) FILTER (j) / count(*) FILTER (j OR (row_type = 'fn_blank' AND v = 'human_found')) AS detection_recall,
      count(*) FILTER (l AND v = 'correct') / count(*) FILTER (j) AS identification_accuracy, count(*) FILTER (j AND trim(human_subfield) = '') / count(*) FILTER (j) AS subfield_accuracy FROM a {group}"""


_A = f"WITH r AS ({_AUDITED}), a AS (SELECT *, nullif(trim(human_verdict), '') AS v, row_type = 'llm' AND nullif(trim(human_verdict), '') IS NOT NULL AS l, row_type = 'llm' AND coalesce(human_verdict IN ('correct', 'wrong_identification'), false) AS j FROM r) "


@query(_A + _sql_metrics("'OVERALL'", "") + " UNION ALL " + _sql_metrics("'source_type=' || source_type", "GROUP BY source_type"))
def val_strata(t):
    return audit.by_strata(t.view(_AUDITED), ("source_type",))


#: Audited citations with gaps: strata are null at times, and humans fill in what they would have said.
_FILLED = """SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderstatus END AS source_type, CASE WHEN o_custkey % 3 = 0 THEN 'likely_scanned' ELSE 'native_text' END AS pdf_extraction_method, o_custkey % 5 = 0 AS doc_text_truncated,
  CASE WHEN o_orderkey % 6 = 0 THEN 'fn_blank' ELSE 'llm' END AS row_type, CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'human_found' WHEN 1 THEN 'wrong_identification' WHEN 2 THEN 'hallucinated' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'correct' END AS human_verdict,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS is_canonical, CASE WHEN o_orderkey % 5 < 3 THEN '' WHEN o_orderkey % 10 < 5 THEN 'true' ELSE 'false' END AS human_is_canonical,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'background' WHEN 1 THEN 'method' WHEN 2 THEN 'data' ELSE 'other' END AS citation_function, CASE WHEN o_orderkey % 3 > 0 THEN NULL WHEN o_orderkey % 11 < 6 THEN 'method' ELSE 'background' END AS human_citation_function FROM {orders}"""
KAPPAS = {"is_canonical": ("is_canonical", "human_is_canonical"), "citation_function": ("citation_function", "human_citation_function")}
_STRATA = ("source_type", "pdf_extraction_method", "doc_text_truncated")
_F = f"WITH r AS ({_FILLED}), a AS (SELECT *, nullif(trim(human_verdict), '') AS v, row_type = 'llm' AND nullif(trim(human_verdict), '') IS NOT NULL AS l, row_type = 'llm' AND coalesce(human_verdict IN ('correct', 'wrong_identification'), false) AS j FROM r), "
_F += "x AS (SELECT 'OVERALL' AS stratum, * FROM a " + " ".join(f"UNION ALL SELECT '{c}=' || coalesce(CAST({c} AS VARCHAR), 'nan'), * FROM a" for c in _STRATA) + "), "
_F += """y AS (SELECT stratum, 'is_canonical' AS k, coalesce(CAST(is_canonical AS VARCHAR), 'nan') AS m, human_is_canonical AS h FROM x WHERE j AND trim(human_is_canonical) <> '' UNION ALL SELECT stratum, 'citation_function', citation_function, human_citation_function FROM x WHERE j AND trim(human_citation_function) <> ''),
  yn AS (SELECT stratum, k, count(*) AS n, avg(CASE WHEN m = h THEN 1.0 ELSE 0.0 END) AS po FROM y GROUP BY ALL), ym AS (SELECT stratum, k, m AS c, count(*) AS n FROM y GROUP BY ALL), yh AS (SELECT stratum, k, h AS c, count(*) AS n FROM y GROUP BY ALL),
  ye AS (SELECT stratum, k, yn.n, po, (SELECT coalesce(sum(ym.n * yh.n), 0) FROM ym JOIN yh USING (stratum, k, c) WHERE ym.stratum = yn.stratum AND ym.k = yn.k) / (yn.n * yn.n) AS pe FROM yn),
  kk AS (SELECT stratum, k, CASE WHEN n >= 5 THEN CASE WHEN abs(1 - pe) < 1e-9 THEN CASE WHEN po = 1 THEN 1.0 END ELSE (po - pe) / (1 - pe) END END AS kappa FROM ye) """


_BY_STRATUM = """SELECT x.stratum, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (l) AS n_llm_audited, count(*) FILTER (l AND v = 'correct') AS correct, count(*) FILTER (l AND v = 'wrong_identification') AS wrong_id, count(*) FILTER (l AND v = 'hallucinated') AS hallucinated,
  count(*) FILTER (row_type = 'fn_blank' AND v = 'human_found') AS fn_found, count(*) FILTER (j) / count(*) FILTER (j OR (l AND v = 'hallucinated')) AS detection_precision, count(*) FILTER (j) / count(*) FILTER (j OR (row_type = 'fn_blank' AND v = 'human_found')) AS detection_recall,
  count(*) FILTER (l AND v = 'correct') / count(*) FILTER (j) AS identification_accuracy, count(*) FILTER (j AND coalesce(trim(human_is_canonical), '') = '') / count(*) FILTER (j) AS is_canonical_accuracy, count(*) FILTER (j AND coalesce(trim(human_citation_function), '') = '') / count(*) FILTER (j) AS citation_function_accuracy,
  round(any_value(p.kappa), 9) AS is_canonical_kappa, round(any_value(q.kappa), 9) AS citation_function_kappa
  FROM x LEFT JOIN kk p ON p.stratum = x.stratum AND p.k = 'is_canonical' LEFT JOIN kk q ON q.stratum = x.stratum AND q.k = 'citation_function' GROUP BY x.stratum"""


@query(_F + f"SELECT * EXCLUDE (stratum) FROM ({_BY_STRATUM}) WHERE stratum = 'OVERALL'")
def val_metrics(t):
    """Metrics of all audited rows, with kappas where humans filled in at least five values."""
    out = audit.metrics(t.view(_FILLED), KAPPAS)
    return out.withColumns({f"{k}_kappa": F.round(f"{k}_kappa", 9) for k in KAPPAS})


@query(_F + _BY_STRATUM)
def val_strata_kappa(t):
    """All strata, null ones too, and the total in one pass, with kappas of what humans filled in."""
    out = audit.by_strata(t.view(_FILLED), _STRATA, KAPPAS)
    return out.withColumns({f"{k}_kappa": F.round(f"{k}_kappa", 9) for k in KAPPAS})


@query("""WITH n AS (SELECT greatest(3, 80 // greatest(count(DISTINCT source), 1)) AS share FROM documents), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id), doc_id) AS place FROM documents)
  SELECT source, doc_id FROM r, n WHERE place <= 80 ORDER BY (place > share), md5('2|' || doc_id), doc_id LIMIT 80""")
def canon_sample(t):
    return audit.spread_sample(t.documents.select("source", "doc_id"), 80, 1)


_OCR = "SELECT doc_id, n_chars AS words_before, CAST(n_chars % 90 AS INT) AS pages, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars + doc_id % 5 - 2 END AS words_after FROM {documents}"


@query(f"WITH o AS ({_OCR}) SELECT doc_id, CASE WHEN NOT (pages > 0 AND words_before / nullif(pages, 0) < 50) THEN 'not_candidate' WHEN words_after IS NULL THEN 'no_output' WHEN words_after <= words_before THEN 'no_improvement' ELSE 'ok' END AS status FROM o")
def ocr_gate(t):
    return t.view(_OCR).select("doc_id", audit.ocr_status(F.col("words_before"), F.col("pages"), F.col("words_after")).alias("status"))


# Report forms.


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def agg_value_counts(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH j AS ({JUDGED}) SELECT a_code, count(*) AS n FROM j GROUP BY 1")
def agg_value_counts_null(t):
    return t.view(JUDGED).groupBy("a_code").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def agg_group_distinct(t):
    return t.orders.where("o_custkey is not null").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def agg_pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 15")
def agg_explode_top(t):
    from ..functions.text import words

    return t.documents.select(F.explode(words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2")
def agg_describe(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"), F.min(q).alias("least"), F.percentile(q, 0.25).alias("q25"), F.percentile(q, 0.5).alias("q50"), F.max(q).alias("most"))


@query("SELECT source, count(*) FILTER (n_chars < 1000) AS small, count(*) FILTER (n_chars < 1000) / count(*) AS ratio, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1")
def agg_conditional_share(t):
    total = t.documents.agg(F.count("*").alias("all"))
    by = t.documents.groupBy("source").agg(F.count_if(F.col("n_chars") < 1000).alias("small"), F.count("*").alias("n"))
    # The total is one row.
    return by.join(F.broadcast(total)).select("source", "small", (F.col("small") / F.col("n")).alias("ratio"), (F.col("n") / F.col("all")).alias("share"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_lookup(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(t):
    return t.documents.select("doc_id").join(t.labels.dropDuplicates(["doc_id"]).select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi(t):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(year(a.o_orderdate) - year(b.o_orderdate)) <= 1")
def join_year_band(t):
    a = t.orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.year("o_orderdate").alias("ya"))
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.year("o_orderdate").alias("yb"))
    return a.join(b, "o_custkey").where((F.col("a") < F.col("b")) & (F.abs(F.col("ya") - F.col("yb")) <= 1)).select("a", "b")


@query("SELECT DISTINCT 'https://x.org/' || r_name || '/' || y || '/' || m AS url FROM region, range(2020, 2023) a(y), range(1, 13) b(m)")
def join_candidate_urls(t):
    dated = t.region.select("r_name", F.explode(F.sequence(F.lit(2020), F.lit(2022))).alias("y")).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    return dated.select(F.concat_ws("/", F.lit("https://x.org"), "r_name", F.col("y").cast("string"), F.col("m").cast("string")).alias("url")).distinct()


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def win_top_k(t):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t.customer.select("c_nationkey", "c_custkey", place.alias("place")).where("place <= 5")


_GAPS = "SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance FROM {customer}"


@query(f"WITH g AS ({_GAPS}) SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY balance ASC NULLS LAST, c_custkey) AS place FROM g")
def sort_nulls_last(t):
    """The order of each group, rows without a value at its end."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last("balance"), "c_custkey"))
    return t.view(_GAPS).select("c_nationkey", "c_custkey", place.alias("place"))


@query("SELECT y, n FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1 ORDER BY y DESC LIMIT 10) ORDER BY y")
def win_tail(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).orderBy(F.desc("y")).limit(10).orderBy("y")


@query("SELECT doc_id, text_id FROM (SELECT doc_id, NULL AS text_id FROM labels UNION ALL SELECT NULL, item_id FROM benchmark)")
def set_union(t):
    return t.labels.select("doc_id").unionByName(t.benchmark.select(F.col("item_id").alias("text_id")), allowMissingColumns=True)


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set_intersection_size(t):
    return t.documents.select("doc_id").distinct().join(t.labels, "doc_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT conv_id FROM conversations")
def set_difference(t):
    return t.documents.select("doc_id").distinct().join(t.conversations.select(F.col("conv_id").alias("doc_id")), "doc_id", "left_anti")
