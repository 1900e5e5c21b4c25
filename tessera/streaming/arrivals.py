"""Incremental arrival: new files of a folder, each handled once, by a file stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, file_format: str = "parquet") -> None:
    """Applies `work` to files that no earlier call with this checkpoint has seen, and appends its rows to `sink`."""
    stream = work(spark.readStream.format(file_format).schema(schema).load(folder))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
