"""Paged services as a Spark source: cursor walks over key ranges, and numbered pages, with bounded retries.

The service is a function that is given to the source and runs on the executors, so the network (or whatever stands for
it) is a parameter. A walk by cursor is sequential, so the keys are split into ranges, each walked by a task of its own. Numbered
pages are dealt out: of n tasks, task k reads pages k, k + n, k + 2 n ... until one is empty or marked as the last.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Again(Exception):
    """Raised by a fetch that is refused for now."""


def _asked(fetch: Callable[[dict], dict], request: dict, tries: int, wait: float, sleep: Callable[[float], None]) -> dict:
    for attempt in range(tries):
        try:
            return fetch(request)
        except Again:
            if attempt + 1 == tries:
                raise
            sleep(wait)
    raise ValueError("tries must be at least 1")


def cursor_rows(fetch: Callable[[dict], dict], request: dict, tries: int, wait: float, sleep: Callable[[float], None]) -> Iterator[dict]:
    """The results of all pages from cursor "*" on. A page without results, or without a next cursor, is the last; a cursor that comes
    twice is an error, as it would be walked for ever."""
    cursor, seen = "*", set()
    while cursor:
        if cursor in seen:
            raise ValueError(f"the service gave the cursor {cursor!r} twice")
        seen.add(cursor)
        page = _asked(fetch, request | {"cursor": cursor}, tries, wait, sleep)
        results = page.get("results") or []
        yield from results
        cursor = page.get("next_cursor") if results else None


def page_rows(fetch: Callable[[dict], dict], request: dict, first: int, step: int, tries: int, wait: float, sleep: Callable[[float], None]) -> Iterator[dict]:
    """The results of pages first, first + step, ... until an empty one or one marked `last` (or behind a known number of `pages`)."""
    page = first
    while True:
        got = _asked(fetch, request | {"page": page}, tries, wait, sleep)
        results = got.get("results") or []
        yield from results
        page += step
        if not results or got.get("last") or ("pages" in got and page >= got["pages"]):
            return


class _Part(InputPartition):
    def __init__(self, number: int, bounds: tuple | None):
        self.number, self.bounds = number, bounds


def _source(kind: str, schema: str, parts: list[_Part], rows_of: Callable[[_Part], Iterator[dict]]) -> type[DataSource]:
    names = T.StructType.fromDDL(schema).names

    class Reader(DataSourceReader):
        def partitions(self):
            return parts

        def read(self, partition):
            for row in rows_of(partition):
                yield tuple(row.get(n) for n in names)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def key_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """(from, below) of `parts` even ranges of the keys low ... high."""
    bounds = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def by_cursor(spark: SparkSession, fetch: Callable[[dict], dict], schema: str, ranges: list[tuple], name: str = "paged_by_cursor", tries: int = 5, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows of a cursor-paged service. fetch: takes from, below, cursor; returns results (records) and next_cursor; raises Again if
    refused, which is tried again after `wait` seconds, `tries` times in all; any other failure fails the task, and Spark repeats
    it. Fields that a record lacks are null."""
    walk = lambda p: cursor_rows(fetch, {"from": p.bounds[0], "below": p.bounds[1]}, tries, wait, sleep)
    spark.dataSource.register(_source(name, schema, [_Part(i, r) for i, r in enumerate(ranges)], walk))
    return spark.read.format(name).load()


def by_page(spark: SparkSession, fetch: Callable[[dict], dict], schema: str, tasks: int, first: int = 0, name: str = "paged_by_number", tries: int = 5, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows of a service with numbered pages (an offset is a page of its size). fetch: takes page; returns results, and if it knows them pages
    (their number, counted with those before `first`) or last. Retries as for by_cursor."""
    walk = lambda p: page_rows(fetch, {}, first + p.number, tasks, tries, wait, sleep)
    spark.dataSource.register(_source(name, schema, [_Part(i, None) for i in range(tasks)], walk))
    return spark.read.format(name).load()
