"""Column helpers for spans of text: regular-expression matches with their places, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = 512
SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row, whatever reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def _running(values: Column, start: Column) -> Column:
    """Sums of all values before each element, from `start`."""
    empty = F.array().cast("array<bigint>")
    state = F.struct(start.alias("sum"), empty.alias("before"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))

    return F.aggregate(values, state, step)["before"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """For each element of an array of bigint the sum of those before it.

    Done in two levels, so that an array of n elements costs about n * sqrt(n) steps at worst, not n * n.
    """
    zero = F.lit(0).cast("bigint")

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_STEP))
        return F.transform(starts, lambda s: F.slice(v, s, F.lit(_STEP)))

    def placed(b: Column) -> Column:
        totals = F.transform(b, lambda part: F.aggregate(part, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(b, _running(totals, zero), _running))

    return let(values, lambda v: let(blocks(v), placed))


def found(text: Column, pattern: Column) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, match>>, in code points, end exclusive.

    `pattern` must not match the empty string.  A null text has none.
    """

    def place(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
        sizes = F.transform(matches, lambda m: F.length(m).cast("bigint"))

        def with_gaps(g: Column) -> Column:
            steps = F.zip_with(F.slice(g, F.lit(1), F.size(matches)), sizes, lambda x, y: x + y)
            ends = F.zip_with(sums_before(steps), steps, lambda x, y: x + y)
            return F.zip_with(
                matches, ends,
                lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")),
            )

        return F.when(F.size(matches) > 0, let(gaps, with_gaps)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def where_cheap(test: Column, value: Column, kind: str) -> Column:
    """`value` where a cheap test holds, else an empty array of `kind`."""
    return F.when(test, value).otherwise(F.array().cast(kind))


def find(text: str, pattern: str, test: Column) -> Column:
    """Matches of a literal pattern in column `text` where `test` holds."""
    return where_cheap(test, found(F.col(text), F.lit(pattern)), SPAN)


def listed(spans: Column, kind: Callable[[Column], Column]) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
