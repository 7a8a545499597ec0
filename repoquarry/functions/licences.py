"""Licence classification of a text, as one projection (no rules join, no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions.text import any_of

PROPRIETARY = "Proprietary"
UNKNOWN = "Unknown"


def license_name(lowered: Column) -> Column:
    """SPDX id, `Proprietary` or NULL for an already lower-cased text.

    The 47 phrase tests sit behind a handful of anchor tests: a text without an
    anchor, nearly every text, skips the whole chain.
    """
    rules_chain = reduce(
        lambda acc, rule: acc.when(any_of([lowered.contains(p) for p in rule[1]]), rule[0]),
        rules.LICENSE_PHRASES[1:],
        F.when(
            any_of([lowered.contains(p) for p in rules.LICENSE_PHRASES[0][1]]), rules.LICENSE_PHRASES[0][0]
        ),
    )
    anchored = any_of([lowered.contains(anchor) for anchor in rules.LICENSE_ANCHORS])
    reserved = any_of([lowered.contains(p) for p in rules.PROPRIETARY_PHRASES])
    proprietary = F.when(reserved & ~lowered.contains(rules.PROPRIETARY_VETO), PROPRIETARY)
    return F.coalesce(F.when(anchored, rules_chain), proprietary)


def classify_license(df: DataFrame, col: str = "content", out: str = "license") -> DataFrame:
    """Add struct column `out` = (detected, name, spdx_id, permissive) for the text in `col`."""
    lowered, name = "__lowered", "__license_name"
    staged = df.withColumn(lowered, F.lower(F.col(col))).withColumn(name, license_name(F.col(lowered)))
    spdx = F.when(F.col(name) != PROPRIETARY, F.col(name))
    return staged.withColumn(
        out,
        F.struct(
            F.col(name).isNotNull().alias("detected"),
            F.col(name).alias("name"),
            spdx.alias("spdx_id"),
            spdx.isNotNull().alias("permissive"),
        ),
    ).drop(lowered, name)


def is_permissive(spdx: Column) -> Column:
    """Case-insensitive membership in the known ids; false for NULL and ''."""
    known = [spdx_id.lower() for spdx_id, _ in rules.LICENSE_PHRASES]
    return F.coalesce(F.lower(spdx).isin(known), F.lit(False))
