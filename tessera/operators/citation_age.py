"""Ages of citations, the hazard of a first citation, and shares over yearly volumes of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ages(citations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, age, n, share, cumulative: how old papers are when they are cited. citations: paper_year, cited_year; rows without
    a year, and those that cite a paper of a later year, take no part."""
    aged = citations.withColumn("age", F.col("cited_year") - F.col("paper_year")).where("age >= 0")
    counted = aged.groupBy(*by, "age").agg(F.count("*").alias("n"))
    # One row an age is left for the windows.
    whole, so_far = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("age")
    return counted.select(*by, "age", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), (F.sum("n").over(so_far) / F.sum("n").over(whole)).alias("cumulative"))


def first_citation_hazard(papers: DataFrame, citations: DataFrame, last_year: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, age, at_risk, events, hazard, survival: of the papers not cited before an age, the share first cited at it.

    papers: paper_id, paper_year and the columns of `by`; citations: paper_id, cited_year. A paper that is never cited leaves
    the risk set after the age it has in last_year; citations after last_year or before the paper don't count. at_risk is
    the number of papers that leave at this age or later, summed from the far end over one row an age. survival is the
    product of 1 - hazard up to the age.
    """
    known = papers.select("paper_id", "paper_year", *by).where(F.col("paper_id").isNotNull() & F.col("paper_year").isNotNull() & (F.col("paper_year") <= last_year))
    cited = citations.select("paper_id", "cited_year").where(F.col("cited_year") <= last_year)
    # The earliest citation that isn't before the paper itself.
    pairs = known.select("paper_id", "paper_year").join(cited, "paper_id").where("cited_year >= paper_year")
    first = pairs.groupBy("paper_id").agg(F.min("cited_year").alias("first_year"))
    spans = known.join(first, "paper_id", "left").select(*by, (F.coalesce("first_year", F.lit(last_year)) - F.col("paper_year")).alias("age"), F.col("first_year").isNotNull().alias("event"))
    leaving = spans.groupBy(*by, "age").agg(F.count("*").alias("leaving"), F.count_if("event").alias("events"))
    on = Window.partitionBy(*by).orderBy("age").rowsBetween(0, Window.unboundedFollowing)
    up_to = Window.partitionBy(*by).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    out = leaving.withColumn("at_risk", F.sum("leaving").over(on)).withColumn("hazard", F.col("events") / F.col("at_risk"))
    gone = F.max((F.col("hazard") >= 1).cast("int")).over(up_to) == 1
    kept = F.exp(F.sum(F.when(F.col("hazard") < 1, F.log(1 - F.col("hazard"))).otherwise(0.0)).over(up_to))
    return out.select(*by, "age", "at_risk", "events", "hazard", F.when(gone, 0.0).otherwise(kept).alias("survival"))


def normalised_share(citations: DataFrame, volumes: DataFrame, by: tuple[str, ...] = (), kept: Column | None = None) -> DataFrame:
    """by, year, n, chosen, share, papers, per_paper, index: the share of chosen citations of a year, and their number over the papers that
    were published in it.

    citations: year and the columns of `by`, `kept` telling which are chosen (all if not given); volumes: year, papers. index is per_paper over that of all years
    together, so that growth of publishing is taken out of a trend. Years without papers have null rates."""
    chosen = F.coalesce(kept, F.lit(False)) if kept is not None else F.lit(True)
    counted = citations.where("year is not null").groupBy(*by, "year").agg(F.count("*").alias("n"), F.count_if(chosen).alias("chosen"))
    sized = volumes.groupBy("year").agg(F.sum("papers").alias("papers"))
    rows = counted.join(sized, "year", "left").withColumn("per_paper", F.col("chosen") / F.nullif("papers", F.lit(0)))
    whole = Window.partitionBy(*by)
    overall = F.sum(F.when(F.col("papers") > 0, F.col("chosen"))).over(whole) / F.nullif(F.sum("papers").over(whole), F.lit(0))
    return rows.select(*by, "year", "n", "chosen", (F.col("chosen") / F.col("n")).alias("share"), "papers", "per_paper", (F.col("per_paper") / F.nullif(overall, F.lit(0.0))).alias("index"))
