"""Agreement, precision and recall, and reproducible samples for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, fields: dict[str, tuple[str, str]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each field: the columns of keep, field, code_value, llm_value (as text), agree (null if a side is)."""
    listed = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("code_value"), F.col(m).cast("string").alias("llm_value")) for f, (c, m) in fields.items()))
    out = df.select(*keep, F.explode(listed).alias("p")).select(*keep, "p.*")
    return out.withColumn("agree", F.col("code_value") == F.col("llm_value"))


def kappa_binary(agree: Column, total: Column, code_true: Column, llm_true: Column) -> Column:
    """Cohen's kappa from marginals; null if chance agreement is certain."""
    po, a, b = agree / F.nullif(total, F.lit(0)), code_true / F.nullif(total, F.lit(0)), llm_true / F.nullif(total, F.lit(0))
    pe = a * b + (1 - a) * (1 - b)
    return (po - pe) / F.nullif(1 - pe, F.lit(0.0))


def agreement(p: DataFrame, by: tuple[str, ...] = ("field",), true: str = "true") -> DataFrame:
    """Counts of null states and agreement, the rate, and kappa of binary fields, for each group."""
    code, llm = F.col("code_value").isNotNull(), F.col("llm_value").isNotNull()
    both = code & llm
    out = p.groupBy(*by).agg(
        F.count("*").alias("total_rows"), F.count_if(~code & ~llm).alias("both_null"), F.count_if(code & ~llm).alias("code_only"), F.count_if(~code & llm).alias("llm_only"), F.count_if(both).alias("both_present"),
        F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("disagree"), F.count_if(both & (F.col("code_value") == true)).alias("code_true"), F.count_if(both & (F.col("llm_value") == true)).alias("llm_true"),
    )
    return out.withColumns({"agreement_rate": F.col("agree") / F.nullif("both_present", F.lit(0)), "kappa": kappa_binary(F.col("agree"), F.col("both_present"), F.col("code_true"), F.col("llm_true"))}).drop("code_true", "llm_true")


def kappa_multi(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, po, pe, kappa over any classes; 1 if both chance and agreement are certain. Classes are grouped before they meet."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("n"))
    left = cells.groupBy(F.col("x").alias("c")).agg(F.sum("n").alias("nx"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    right = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("ny"))
    total = left.join(right, "c", "full").agg(F.sum("nx").alias("n"), F.sum("same").alias("same"), F.sum(F.coalesce(F.col("nx") * F.col("ny"), F.lit(0))).alias("cross"))
    out = total.select("n", (F.col("same") / F.nullif("n", F.lit(0))).alias("po"), (F.col("cross") / F.nullif(F.col("n") * F.col("n"), F.lit(0))).alias("pe"))
    sure = F.abs(1 - F.col("pe")) < 1e-9
    return out.withColumn("kappa", F.when(sure, F.when(F.col("po") == 1, 1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def hash_order(seed: int, *keys: str) -> Column:
    """A reproducible order that no data decides: by md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def allocate(strata: DataFrame, n: int, stratum: str = "stratum") -> DataFrame:
    """stratum, rows, take: proportional shares of n, at least one each; what is over is taken from the largest shares, one by one (of equals from the first
    by name), but never the last of a stratum.

    Taking from the largest again and again levels the shares at a threshold L: all above it end at L, but for the last few by name, which
    keep L + 1. L follows from the numbers of strata by share, of which there are no more than about sqrt(2 n) different ones, so
    no list of strata is needed and only that small table is in one place.
    """
    # Each is one row, so joining them to all strata repeats nothing.
    total = strata.agg(F.sum("rows").alias("total"))
    shared = strata.join(F.broadcast(total)).withColumn("share", F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("rows") / F.col("total")).cast("long"))).drop("total")
    by_share = shared.groupBy("share").agg(F.count("*").alias("k"))
    before = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("share").rowsBetween(0, Window.unboundedFollowing)
    # Between two shares the sum of all min(share, L) grows by the number of those above.
    steps = by_share.select("share", F.coalesce(F.sum(F.col("share") * F.col("k")).over(before), F.lit(0)).alias("below"), F.sum("k").over(on).alias("above"))
    over = steps.where(F.col("below") + F.col("share") * F.col("above") > n)
    least = over.agg(F.min_by(F.struct("below", "above"), "share").alias("s"))
    # The floor of one is kept even where that is more than n.
    found = least.where("s is not null").select(F.greatest(F.lit(1), F.floor((F.lit(n) - F.col("s.below")) / F.col("s.above")).cast("long")).alias("level"), (F.lit(n) - F.col("s.below")).alias("left"), F.col("s.above").alias("above"))
    level = found.select("level", F.greatest(F.lit(0), F.col("left") - F.col("level") * F.col("above")).alias("extra"))
    row = level.first()
    if row is None:
        return shared.select(stratum, "rows", F.col("share").cast("int").alias("take"))
    marked = shared.withColumns({"level": F.lit(row.level), "cut": F.col("share") > row.level})
    lifted = marked.where("cut").orderBy(F.desc(stratum)).limit(int(row.extra)).select(stratum, F.lit(1).alias("one"))
    take = F.when(F.col("cut"), F.col("level") + F.coalesce("one", F.lit(0))).otherwise(F.col("share"))
    return marked.join(lifted, stratum, "left").select(stratum, "rows", take.cast("int").alias("take"))


def stratified(df: DataFrame, n: int, stratum: str, key: str, seed: int = 0) -> DataFrame:
    """At most n rows, shared among strata in proportion; everything if there are no more. Nulls are a stratum."""
    named = df.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("__unknown__")))
    strata = named.groupBy("stratum").agg(F.count("*").alias("rows"))
    if (strata.agg(F.sum("rows")).first()[0] or 0) <= n:
        return named.drop("stratum")
    takes = allocate(strata, n).select("stratum", "take")
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(seed, key), key))
    return named.withColumn("rank", rank).where(F.col("rank") <= n).join(F.broadcast(takes), "stratum").where("rank <= take").drop("stratum", "rank", "take")


def first_by_hash(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(max(n, 0))


def review_sample(docs: DataFrame, n: int, seed: int = 0, scanned: int = 5, truncated: int = 5, per_source: int = 2) -> DataFrame:
    """doc_id, stratum: some scanned and truncated documents, some of each source, then others until n; each step leaves
    out what was picked before. docs: doc_id, source_type, pdf_extraction_method, doc_text_truncated, llm_status."""
    good = docs.where("llm_status = 'ok'").select("doc_id", "source_type", "pdf_extraction_method", "doc_text_truncated")
    picked = first_by_hash(good.where("pdf_extraction_method = 'likely_scanned'"), scanned, seed + 1).select("doc_id", F.lit("oversample_scanned").alias("stratum"))
    rest = lambda: good.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_anti")  # noqa: E731  at most n + a few ids
    more = first_by_hash(rest().where("doc_text_truncated"), truncated, seed + 2)
    picked = picked.unionByName(more.select("doc_id", F.lit("oversample_truncated").alias("stratum")))
    rank = F.row_number().over(Window.partitionBy("source_type").orderBy(hash_order(seed + 3, "doc_id"), "doc_id"))
    each = rest().where(F.col("source_type").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= per_source)
    picked = picked.unionByName(each.select("doc_id", F.concat(F.lit("src_min_"), "source_type").alias("stratum")))
    others = first_by_hash(rest(), n - picked.count(), seed + 4)
    return picked.unionByName(others.select("doc_id", F.concat(F.lit("fill_"), F.coalesce("source_type", F.lit("unknown"))).alias("stratum")))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _kappa_of_cells(cells: Column, least: int) -> Column:
    """Cohen's kappa of an array of (a, b, n); null below `least` rows, 1 if both chance and agreement are certain."""
    n = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    same = F.aggregate(F.filter(cells, lambda c: c["a"] == c["b"]), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    of = lambda side, value: F.aggregate(F.filter(cells, lambda c: c[side] == value), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    classes = F.array_distinct(F.transform(cells, lambda c: c["a"]))
    cross = F.aggregate(classes, F.lit(0).cast("long"), lambda s, v: s + of("a", v) * of("b", v))
    po, pe = same / n, cross / (n * n)
    return F.when(n >= least, F.when(F.abs(1 - pe) < 1e-9, F.when(same == n, 1.0)).otherwise((po - pe) / (1 - pe)))


def grouped_metrics(df: DataFrame, sets: tuple[tuple[str, ...], ...], kappas: dict[str, tuple[str, str]] | None = None, least_filled: int = 5) -> DataFrame:
    """Metrics for each group of each of several groupings, from one pass over the rows: the columns of all sets, grouping_id (which of
    them are not part of a row's grouping, so that a null group and a total differ), then as `metrics`.

    kappas: name: (model's column, human's column); kappa of the judged rows that a human filled, null where these are fewer than
    `least_filled`. A row is expanded to its groupings and, for each kappa that it counts for, to a pair of values; pairs are counted before they are put
    together, so a group holds no more of them than there are pairs of classes."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    audited = ~_blank("human_verdict")
    llm = audited & (F.col("row_type") == "llm")
    judged = llm & F.col("human_verdict").isin("correct", "wrong_identification")
    fields = [c for c in df.columns if c.startswith("human_") and c != "human_verdict"]
    verdict = lambda v: llm & (F.col("human_verdict") == v)
    flags = {"n_llm_audited": llm, "correct": verdict("correct"), "wrong_id": verdict("wrong_identification"), "hallucinated": verdict("hallucinated"), "fn_found": audited & (F.col("row_type") == "fn_blank") & (F.col("human_verdict") == "human_found")}
    flags |= {f"ok_{c[6:]}": judged & _blank(c) for c in fields}
    nothing = F.lit(None).cast("string")
    part = lambda name, a, b: F.struct(name.alias("kappa"), a.alias("a"), b.alias("b"))
    pairs = [F.when(judged & ~_blank(h), part(F.lit(k), F.coalesce(F.col(m).cast("string"), F.lit("nan")), F.col(h).cast("string"))) for k, (m, h) in (kappas or {}).items()]
    listed = F.filter(F.array(part(nothing, nothing, nothing), *pairs), lambda x: x.isNotNull())
    rows = df.select(*columns, "doc_id", *(F.coalesce(f, F.lit(False)).alias(n) for n, f in flags.items()), F.explode(listed).alias("x")).select(*columns, "doc_id", *flags, "x.*")
    first = F.col("kappa").isNull()
    counted = rows.groupingSets([[*s, "kappa", "a", "b"] for s in sets], *columns, "kappa", "a", "b").agg(
        F.grouping_id().alias("gid"), F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in flags)
    )
    # The three columns of pairs are part of every grouping, so their bits are 0.
    of_group = [*columns, F.shiftright("gid", 3).alias("grouping_id")]
    cells = lambda k: F.collect_list(F.when(F.col("kappa") == k, F.struct("a", "b", "n")))
    out = counted.groupBy(*of_group).agg(*(F.max(F.when(first, F.col(c))).alias(c) for c in ("n_docs", *flags)), *(_kappa_of_cells(cells(k), least_filled).alias(f"{k}_kappa") for k in kappas or {}))
    tp = F.col("correct") + F.col("wrong_id")
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    rates = {"detection_precision": over(tp, tp + F.col("hallucinated")), "detection_recall": over(tp, tp + F.col("fn_found")), "identification_accuracy": over(F.col("correct"), tp)}
    return out.withColumns(rates | {f"{c[6:]}_accuracy": over(F.col(f"ok_{c[6:]}"), tp) for c in fields}).drop(*(f"ok_{c[6:]}" for c in fields))


def metrics(df: DataFrame, kappas: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Precision and recall of detection, accuracy of identification and of fields (a blank correction agrees), and kappas where they are told."""
    return grouped_metrics(df, ((),), kappas).drop("grouping_id")


def by_strata(df: DataFrame, columns: tuple[str, ...], kappas: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Metrics of all rows (OVERALL) and of each value of each column, labelled column=value (a null value is nan), from one pass."""
    out = grouped_metrics(df, ((), *((c,) for c in columns)), kappas)
    label = F.lit("OVERALL")
    for i, c in enumerate(columns):
        # The bit of the only column that is grouped by is 0.
        own = F.col("grouping_id") == (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        label = F.when(own, F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan")))).otherwise(label)
    return out.withColumn("stratum", label).drop("grouping_id", *columns)


def template(rows: DataFrame, blanks: int = 10) -> DataFrame:
    """doc_id, row_type, idx: model rows of each document, then blank ones for what was missed."""
    listed = rows.select("doc_id", F.lit("llm").alias("row_type"), F.row_number().over(Window.partitionBy("doc_id").orderBy("row_id")).alias("idx"))
    empty = rows.select("doc_id").distinct().select("doc_id", F.lit("fn_blank").alias("row_type"), F.explode(F.sequence(F.lit(1), F.lit(blanks))).alias("idx"))
    return listed.unionByName(empty)


def spread_sample(files: DataFrame, n: int, seed: int = 0, least: int = 3) -> DataFrame:
    """At most n rows of source, doc_id: an even share of each source (at least `least`), then others, trimmed to n."""
    sources = files.select("source").distinct().count()
    share = max(least, n // max(sources, 1))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(hash_order(seed, "doc_id"), "doc_id"))
    # Rows beyond n of a source can never be taken.
    ranked = files.withColumn("rank", rank).where(F.col("rank") <= n)
    return ranked.orderBy((F.col("rank") > share).cast("int"), hash_order(seed + 1, "doc_id"), "doc_id").limit(n).drop("rank")


def ocr_status(words_before: Column, pages: Column, words_after: Column, least: int = 50) -> Column:
    """What becomes of a file: only candidates are tried, and only more words are accepted."""
    candidate = (pages > 0) & (words_before / F.nullif(pages, F.lit(0)) < least)
    return F.when(~F.coalesce(candidate, F.lit(False)), "not_candidate").when(words_after.isNull(), "no_output").when(words_after <= words_before, "no_improvement").otherwise("ok")
