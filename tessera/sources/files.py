"""Files in and out: corpora of documents, CSV, rule files, and the choice among inputs."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import content_id


def corpus(spark: SparkSession, root: str, pattern: str = "*", skip_prefix: str = "_", skip_folder: str = "_temp_downloads") -> DataFrame:
    """path, source (folder), name, kind (ending), size, content, doc_id (of the bytes) of every file under a folder; names
    and folders that begin with the prefix are left out. Columns that a query doesn't use aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("source"), F.element_at(parts, -1).alias("name"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"), F.col("length").alias("size"), "content")
    kept = out.where(~F.col("name").startswith(skip_prefix) & ~F.col("source").startswith(skip_prefix) & ~F.contains("path", F.lit(f"/{skip_folder}/")))
    return kept.withColumn("doc_id", content_id(F.col("content")))


def text_of(content: Column, kind: Column, readers: dict[str, Callable[[Column], Column]] | None = None, plain: tuple[str, ...] = ("txt", "text")) -> Column:
    """Text of files by their ending: plain ones are decoded, others go to the reader for their kind (a function of the content, such as one that reads the text
    layer of a PDF); a kind without a reader has null, as a file that can't be read has."""
    out = F.when(F.lower(kind).isin(*plain), decoded(content))
    for name, reader in (readers or {}).items():
        out = out.when(F.lower(kind) == name.lower(), reader(content))
    return out


def cached(df: DataFrame, path: str) -> DataFrame:
    """The rows stored under a path, which are made if there are none yet: a stage is computed once, whatever reads it. A store that is only half written
    (it lacks Spark's mark) is made anew."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order that names every row; all if n is None or 0, none if there are none."""
    return df.orderBy(*order).limit(n) if n else df


def decoded(content: Column) -> Column:
    """Text of UTF-8 bytes; broken bytes become replacement characters."""
    return F.decode(content, "UTF-8")


def read_csv(spark: SparkSession, path: str, schema: str, line_feeds: bool = True) -> DataFrame:
    """Typed CSV with doubled quotes. line_feeds: whether values may hold line feeds, for which each file is one task;
    without them large files are split. Parquet is the better format for large tables."""
    return spark.read.schema(schema).option("header", True).option("multiLine", line_feeds).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, append: bool = False) -> None:
    writer = df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"')
    writer.option("quoteAll", quote_all).csv(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that driver and executors share (spark.checkpoint.dir). On one machine without that setting, a temporary folder is taken;
    on a cluster no machine's own folder would do, so it must be set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def rules(text: str) -> dict:
    """A rule file: JSON, or YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, candidates: list[str], override: str | None = None) -> str:
    """The override, which must be there, else the first candidate that is."""
    for c in [override] if override is not None else candidates:
        if exists(spark, c):
            return c
    raise FileNotFoundError(f"none of {[override] if override is not None else candidates}")


def documents_input(spark: SparkSession, beside: str, name: str, default: str, override: str | None = None) -> str | None:
    """The override, else the file beside the citations, else the default, else none."""
    if override is not None:
        return first_existing(spark, [], override)
    return next((p for p in (f"{beside.rsplit('/', 1)[0]}/{name}", default) if exists(spark, p)), None)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not processed before."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def from_source(df: DataFrame, prefix: str, column: str = "source") -> DataFrame:
    """Sources from the first one with the prefix on, in order of names; all if none has it."""
    start = df.where(F.col(column).startswith(prefix)).agg(F.min(column)).first()[0]
    return df if start is None else df.where(F.col(column) >= start)


def sitemap_urls(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """url: distinct addresses of <loc> elements that match, ascending."""
    found = F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    return df.select(found.alias("url")).where(F.col("url").rlike(pattern)).distinct().orderBy("url")


def rejected(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with it)."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
