"""The hook for extractors that may fail: batched, with bounded retries, and a status row in place of a failed task."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a document.
OK, JSON_ERROR, API_ERROR, MAX_RETRIES = "ok", "json_error", "api_error", "max_retries"


class RateLimited(Exception):
    """Raised by an extractor that wants to be asked again later."""


def _one(extractor: Callable[[list[str]], list[str]], text: str, tries: int, wait: float, sleep: Callable[[float], None]) -> tuple:
    """(status, json_valid, retry_count, answer, error) of one text."""
    for attempt in range(tries):
        try:
            (raw,) = extractor([text])
        except RateLimited:
            # No answer can follow the last try, so nothing is waited for after it.
            if attempt + 1 < tries:
                sleep(wait * (attempt + 1))
            continue
        except Exception as e:  # noqa: BLE001  whatever fails in a foreign extractor concerns this text alone
            return API_ERROR, False, attempt, None, f"{type(e).__name__}: {e}"[:500]
        return _parsed(raw, attempt)
    return MAX_RETRIES, False, tries, None, None


def _parsed(raw: str | None, attempt: int) -> tuple:
    bare = re.sub(r"\s*```$", "", re.sub(r"^```json\s*", "", (raw or "").strip()))
    try:
        answer = json.loads(bare)
    except ValueError as e:
        return JSON_ERROR, False, attempt, None, str(e)[:500]
    if not isinstance(answer, dict):
        return JSON_ERROR, False, attempt, None, f"an object is wanted, not {type(answer).__name__}"
    return OK, True, attempt, json.dumps(answer), None


def _batch(extractor: Callable, texts: list[str], tries: int, wait: float, sleep: Callable[[float], None]) -> list[tuple]:
    """All texts in one call; if that fails or gives another number of answers, each text alone."""
    try:
        if len(texts) > 1 and len(raws := extractor(texts)) == len(texts):
            return [_parsed(r, 0) for r in raws]
    except Exception:  # noqa: BLE001  each text is asked alone, where its own failure is told
        pass
    return [_one(extractor, t, tries, wait, sleep) for t in texts]


ANSWERS = "llm_status string, json_valid boolean, retry_count int, answer string, extraction_error string"


def answers(docs: DataFrame, key: str, text: Column, extractor: Callable[[list[str]], list[str]], skip: Column | None = None, tries: int = 5, wait: float = 30.0, size: int = 16, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, llm_status, json_valid, retry_count, answer (JSON text of an object), extraction_error for every row.

    extractor: takes texts, returns as many answers, each a JSON object, fenced or not. It is asked for `size` texts at once. A
    RateLimited is tried again after wait, 2 wait, ... seconds, `tries` times in all, then max_retries; any other failure is
    api_error, an answer that is no object json_error, both without another try; a batch that fails is asked text by text. skip: a status for rows that
    are not to be sent (null: send); they have null json_valid and no retries. A null text is sent as an empty one. A repeated
    key is a row of its own. The extractor may be asked again for a text if its task is repeated.
    """
    sent = F.coalesce(text.cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), sent.alias("text"), (skip if skip is not None else F.lit(None)).cast("string").alias("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skips = b.column("skip").to_pylist()
            out: list[tuple | None] = [(s, None, 0, None, None) if s is not None else None for s in skips]
            asked = [i for i, s in enumerate(skips) if s is None]
            for at in range(0, len(asked), size):
                part = asked[at : at + size]
                for i, got in zip(part, _batch(extractor, b.column("text").take(pa.array(part)).to_pylist(), tries, wait, sleep)):
                    out[i] = got
            status, valid, retries, answer, error = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "llm_status": pa.array(status, pa.string()), "json_valid": pa.array(valid, pa.bool_()), "retry_count": pa.array(retries, pa.int32()), "answer": pa.array(answer, pa.string()), "extraction_error": pa.array(error, pa.string())})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {ANSWERS}").withColumnRenamed("key", key)


def parsed(found: DataFrame, source: str, citation: str) -> DataFrame:
    """The answers with `source` (a struct of the given fields) and `citations` (an array of structs). Fields of another type are null, as are those missing."""
    return found.withColumn("a", F.from_json("answer", f"struct<source: struct<{source}>, citations: array<struct<{citation}>>>")).select("*", F.col("a.source").alias("source"), F.col("a.citations").alias("citations")).drop("a")


def document_rows(found: DataFrame, key: str, fallback_title: Column) -> DataFrame:
    """A row a document: status columns, title (the fallback if the answer has none), n_citations, extraction_note null."""
    title = F.col("source.title")
    return found.select(key, "llm_status", "json_valid", "retry_count", F.when(title != "", title).otherwise(fallback_title).alias("title"), F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"))


def citation_rows(found: DataFrame, docs: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """A row a citation: its fields beside those of its document, which are joined to the few that have any."""
    listed = found.where("llm_status = 'ok'").select(key, F.posexplode("citations").alias("place", "c")).select(key, "place", "c.*")
    return listed.join(docs.select(key, *fields), key, "left")
