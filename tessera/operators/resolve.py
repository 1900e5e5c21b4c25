"""Resolution of one value from several sources, with the source that won."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import flag


def academic(code: Column, llm: Column) -> tuple[Column, Column]:
    """(value, source): the code's value, else the model's. A source counts where its raw value is there."""
    value = F.coalesce(flag(code), flag(llm))
    return value, F.when(code.isNotNull(), "code").when(llm.isNotNull(), "llm").otherwise("none")


def canonical_code(pattern_id: Column, metric_only: Column) -> Column:
    """True for a pattern that isn't hedged, else null: no pattern is no proof of the contrary."""
    return F.when(pattern_id.isNotNull() & ~F.coalesce(flag(metric_only), F.lit(False)), True)


def canonical(code: Column, llm: Column, metric_only: Column) -> tuple[Column, Column]:
    c, m, h = F.coalesce(flag(code), F.lit(False)), flag(llm), F.coalesce(flag(metric_only), F.lit(False))
    value = F.when(c | h, True).otherwise(m)
    return value, F.when(c, "code").when(h, "structural_uncertain").when(m.isNotNull(), "llm").otherwise("none")


def year_code(path: Column, frontmatter: Column) -> tuple[Column, Column]:
    return F.coalesce(path, frontmatter), F.when(path.isNotNull(), "path").when(frontmatter.isNotNull(), "frontmatter")


def year(path: Column, frontmatter: Column, llm: Column, metadata: Column) -> tuple[Column, Column]:
    """Path, then front matter, then the model, then file metadata."""
    label = F.when(path.isNotNull(), "path").when(frontmatter.isNotNull(), "frontmatter").when(llm.isNotNull(), "llm").when(metadata.isNotNull(), "pdf_metadata").otherwise("none")
    return F.coalesce(path, frontmatter, llm, metadata), label


MERGE_DEFAULTS = {"citation_source": ("string", "llm"), "within_doc_mention_count": ("int", None), "canonical_pattern_id": ("string", None), "likely_metric_only": ("boolean", False)}


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds the columns of the merge that are missing."""
    return df.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in MERGE_DEFAULTS.items() if c not in df.columns})


def stamp(df: DataFrame, version: str) -> DataFrame:
    """Keeps schema_version as schema_version_src and sets the new one."""
    old = F.col("schema_version").cast("string") if "schema_version" in df.columns else F.lit(None).cast("string")
    return df.withColumn("schema_version_src", old).withColumn("schema_version", F.lit(version))


def backfill(df: DataFrame, columns: tuple[str, ...], sentinel: str = "pre_phase_0") -> DataFrame:
    """Fills null and blank values, and missing columns; a second time it changes nothing."""
    fill = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(sentinel)).otherwise(F.col(c).cast("string"))
    return df.withColumns({c: fill(c) if c in df.columns else F.lit(sentinel) for c in columns})


def agreement(df: DataFrame, code: str, llm: str) -> DataFrame:
    """both (rows with both values), agree, rate."""
    both = F.col(code).isNotNull() & F.col(llm).isNotNull()
    out = df.agg(F.count_if(both).alias("both"), F.count_if(both & (F.col(code) == F.col(llm))).alias("agree"))
    return out.withColumn("rate", F.col("agree") / F.nullif("both", F.lit(0)))


def overlap(df: DataFrame, signals: tuple[str, ...], near: float = 0) -> DataFrame:
    """present, close, n: how many rows have which signals, and which pairs of those differ by at most `near`.

    present has a bit for each signal that is not null, the first signal's the lowest; close a bit for each pair (first with second, first with third, ...) of
    present signals that are near. All intersections follow from these counts: there are few regions, and one aggregation makes them.
    """
    bits = sum(F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(signals))
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    close = sum((F.when(F.abs(F.col(a) - F.col(b)) <= near, 1 << i).otherwise(0) for i, (a, b) in enumerate(pairs)), F.lit(0))
    return df.groupBy(bits.cast("int").alias("present"), close.cast("int").alias("close")).agg(F.count("*").alias("n"))


def overlap_report(regions: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """all_present, then <a>_<b> for each pair: of the rows with all signals, how many have that pair close. regions: from `overlap`."""
    every = F.col("present") == (1 << len(signals)) - 1
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1 :]]
    n = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return regions.agg(n(every).alias("all_present"), *(n(every & (F.shiftright("close", i) % 2 == 1)).alias(f"{a}_{b}") for i, (a, b) in enumerate(pairs)))


def disagreeing(df: DataFrame, code: str, llm: str, venue: str, most: int = 10, rows: str | None = None) -> DataFrame:
    """venue, n: the venues with most rows in which both values are there and differ; of equals the first by name. Rows without a venue take no part.
    rows: a column that says how many rows each one stands for."""
    # A sum, not a filter, which Spark would apply to every row before it counts equal ones.
    apart = F.when(F.col(code) != F.col(llm), F.col(rows) if rows else F.lit(1))
    counted = df.where(F.col(venue).isNotNull()).groupBy(F.col(venue).alias("venue")).agg(F.sum(apart).alias("n"))
    return counted.where("n > 0").orderBy(F.desc("n"), "venue").limit(most)
