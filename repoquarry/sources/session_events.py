"""Session event logs, as batch or streaming input with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_SCHEMA = "session_id string, seq bigint, ts timestamp, type string, content string, delta string"


def read_events(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).format(format).load(path)


def stream_events(spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS_SCHEMA).format(format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
