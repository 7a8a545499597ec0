"""Control over where an expression is evaluated, and how often it is built."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Built = TypeVar("Built")


def built_once(build: Callable[..., Built]) -> Callable[..., Built]:
    """Keep the columns a function builds from plain names for the life of the Spark context.

    Columns are immutable, and a large one takes the driver longer to assemble
    than a small query takes to run.
    """
    kept: dict[tuple, Built] = {}

    @wraps(build)
    def lookup(*names: str) -> Built:
        key = (SparkSession.active().sparkContext.applicationId, *names)
        if key not in kept:
            kept[key] = build(*names)
        return kept[key]

    return lookup


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Catalyst copies the expression of a plain projected column into every
    filter and array function that reads it.  The output of a generator is a
    column to them instead; this one yields a single row per input row.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
