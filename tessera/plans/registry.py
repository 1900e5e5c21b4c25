"""Queries by name, each with the SQL that gives the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder as attributes, and views made by SQL that both engines understand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        """SQL over the tables, named in braces."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL for an engine in which the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[key] = plain(sql)
        return f

    return register
