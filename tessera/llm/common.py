"""Shared folders, cut lineage and small helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine, as in tests, a temporary one; on a cluster
    no machine's own folder would do."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared folder, so that later stages neither recompute nor lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(*frames: DataFrame | None) -> None:
    """Removes what cut() stored for these frames. Nothing may read them any more: all that was made of them is cut itself."""
    for df in frames:
        if df is None:
            continue
        plan = df._jdf.queryExecution().analyzed()
        while plan.nodeName() == "Project":
            plan = plan.child()
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            remove_path(df.sparkSession, file.get())


def collect_garbage(spark: SparkSession) -> None:
    """Lets the driver forget the plans of ended steps; Spark then removes their shuffle files, which otherwise stay until
    the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of a task's batches, taken and given, from which on its worker tidies up: for less, tidying costs more than the task.
TIDY_FROM = 1 << 20


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives back the memory that it no longer uses; else what the largest task took stays with each worker, beside what
    later steps take."""

    def wrapped(batches: Iterator) -> Iterator:
        moved = 0

        def counted() -> Iterator:
            nonlocal moved
            for b in batches:
                moved += b.nbytes
                yield b

        try:
            for b in run(counted()):
                moved += b.nbytes
                yield b
        finally:
            if moved >= TIDY_FROM:
                gc.collect()
                pa.default_memory_pool().release_unused()
                with contextlib.suppress(OSError, AttributeError):
                    # Only the C library of Linux has this.
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def binaries(data: bytes, offsets) -> pa.Array:
    """A binary column over one buffer, without copies of its values."""
    import numpy as np

    off = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def wrap(docs: DataFrame) -> DataFrame:
    """row (all columns as one struct), doc_id, text: names that an operator adds can't clash with those of the input."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*fields).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unwrap(df: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `row`, with its text replaced."""
    return df.select((F.col("row").withField("text", text) if text is not None else F.col("row")).alias("row")).select("row.*")


def with_fields(kept: list, ddl: str):
    """A schema: the kept fields, then those of a DDL string."""
    from pyspark.sql import types as T

    return T.StructType([*kept, *T.StructType.fromDDL(ddl).fields])


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
