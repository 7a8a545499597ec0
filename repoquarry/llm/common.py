"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
PIECE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a run of very long texts stays within a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `PIECE_BYTES` of text each, at least one row."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo `modulus`: the fold of a row."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    name = "repoquarry_worker_cache"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__
