"""How far groups (sources, channels) differ in what they cite: similarity of sparse frequency vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(df: DataFrame, group: Column, term: Column) -> DataFrame:
    """group, term, weight: how often a term occurs in a group. Rows without either take no part."""
    return df.select(group.alias("group"), term.alias("term")).where("`group` is not null and term is not null").groupBy("group", "term").agg(F.count("*").alias("weight"))


def norms(vectors: DataFrame) -> DataFrame:
    """group, terms (distinct), total, norm (Euclidean) of each vector."""
    w = F.col("weight").cast("double")
    return vectors.groupBy("group").agg(F.count("*").alias("terms"), F.sum("weight").alias("total"), F.sqrt(F.sum(w * w)).alias("norm"))


def measures(vectors: DataFrame) -> DataFrame:
    """One row a pair of groups (a < b): shared (terms of both), overlap, cosine and, as a baseline, jaccard.

    Pairs meet in the inverted lists of their terms: a list holds each group once, so a term however common makes
    no more rows than there are pairs of groups, and products are summed where they are made. Groups that share
    nothing have a row of zeros, as measures of all pairs are asked for; there is one row a group to pair for that.
    Weights must be positive and each (group, term) there once.
    """
    left = vectors.select("term", F.col("group").alias("a"), F.col("weight").cast("double").alias("wa"))
    right = vectors.select("term", F.col("group").alias("b"), F.col("weight").cast("double").alias("wb"))
    met = left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    of = norms(vectors)
    side = lambda s: of.select(F.col("group").alias(s), F.col("terms").alias(f"terms_{s}"), F.col("norm").alias(f"norm_{s}"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b")).join(met, ["a", "b"], "left")
    shared, dot = F.coalesce("shared", F.lit(0)), F.coalesce("dot", F.lit(0.0))
    return pairs.select(
        "a", "b", "terms_a", "terms_b", shared.alias("shared"), (shared / F.least("terms_a", "terms_b")).alias("overlap"),
        (dot / (F.col("norm_a") * F.col("norm_b"))).alias("cosine"), (shared / (F.col("terms_a") + F.col("terms_b") - shared)).alias("jaccard"),
    )


def purity(authors: DataFrame, benchmark: DataFrame) -> DataFrame:
    """group, authors, known, purity: one less the share of a group's authors who have a paper in the benchmark.

    authors: group, author; benchmark: author. Null authors take no part; an author counts once a group."""
    own = authors.select("group", "author").where("author is not null").distinct()
    marked = own.join(benchmark.select("author", F.lit(1).alias("seen")).distinct(), "author", "left")
    out = marked.groupBy("group").agg(F.count("*").alias("authors"), F.count("seen").alias("known"))
    return out.withColumn("purity", 1 - F.col("known") / F.col("authors"))
