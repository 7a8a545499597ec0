"""Licence of a repository, and the gate that keeps non-permissive ones out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions import json_values as js
from repoquarry.functions.licences import UNKNOWN, classify_license, is_permissive
from repoquarry.functions.text import WIDE_SPACE, strip_space

LICENSE_TYPE = "struct<detected:boolean,name:string,spdx_id:string,permissive:boolean,file:string>"


def resolve_license(files: DataFrame) -> DataFrame:
    """(repo_id, license struct): the deciding file of every repository.

    The first existing licence file decides even when its text is not
    recognised; then the manifest fields; else undetected.  Every candidate is
    classified where it is read, so only small structs are shuffled.
    """
    names = rules.LICENSE_FILES
    wanted = [*names, "package.json", "pyproject.toml"]
    candidates = files.where(F.col("path").isin(*wanted)).select("repo_id", "path", "content")

    priority = reduce(
        lambda acc, item: acc.when(F.col("path") == item[1], F.lit(item[0])),
        list(enumerate(wanted))[1:],
        F.when(F.col("path") == wanted[0], F.lit(0)),
    )
    is_text = F.col("path").isin(*names)
    is_package = F.col("path") == "package.json"
    pattern = rules.PYPROJECT_LICENSE.replace(r"\s", WIDE_SPACE)

    staged = candidates.withColumn("priority", priority)
    staged = staged.withColumn("__text", F.when(is_text, F.col("content")))
    staged = classify_license(staged, "__text", "__found")
    staged = js.with_json(staged.withColumn("__pkg", F.when(is_package, F.col("content"))), "__pkg", "__json")
    declared = js.field(F.col("__json"), "license")
    staged = staged.withColumn(
        "__declared",
        F.when(is_package & (js.kind(declared) == "STRING"), F.nullif(js.text_of(declared), F.lit(""))).when(
            (F.col("path") == "pyproject.toml") & F.col("content").rlike(pattern),
            strip_space(F.regexp_extract("content", pattern, 1)),
        ),
    )
    found, declared_id = F.col("__found"), F.col("__declared")
    decision = F.when(
        is_text & found["detected"],
        F.struct(
            F.lit(True).alias("detected"), found["name"].alias("name"), found["spdx_id"].alias("spdx_id"),
            found["permissive"].alias("permissive"), F.col("path").alias("file"),
        ),
    ).when(
        is_text,
        F.struct(
            F.lit(True).alias("detected"), F.lit(UNKNOWN).alias("name"), F.lit(None).cast("string").alias("spdx_id"),
            F.lit(False).alias("permissive"), F.col("path").alias("file"),
        ),
    ).when(
        declared_id.isNotNull(),
        F.struct(
            F.lit(True).alias("detected"), declared_id.alias("name"), declared_id.alias("spdx_id"),
            is_permissive(declared_id).alias("permissive"), F.col("path").alias("file"),
        ),
    )
    # undecided rows are skipped inside the aggregate: as a filter the whole chain would be evaluated twice
    ranked = staged.select("repo_id", "priority", decision.alias("license"))
    best = ranked.groupBy("repo_id").agg(
        F.min(F.when(F.col("license").isNotNull(), F.struct("priority", "license"))).alias("best")
    )
    nothing = F.expr(
        f"cast(named_struct('detected', false, 'name', null, 'spdx_id', null, 'permissive', false, 'file', null) AS {LICENSE_TYPE})"
    )
    repos = files.select("repo_id").distinct()
    return repos.join(best, "repo_id", "left").select(
        "repo_id", F.coalesce(F.col("best.license").cast(LICENSE_TYPE), nothing).alias("license")
    )


def license_gate(profile: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split on the `license` struct: (allowed rows, blocked `(repo_id, reason)` rows).

    A dry run lets everything through and blocks nothing.
    """
    permissive = F.coalesce(F.col("license.permissive"), F.lit(False))
    allowed = profile.where(permissive | F.lit(dry_run))
    reason = F.when(~F.col("license.detected"), "No license file found.").otherwise(
        F.format_string('License "%s" is not permissive.', F.col("license.name"))
    )
    return allowed, profile.where(~permissive & ~F.lit(dry_run)).select("repo_id", reason.alias("reason"))


def metadata_gate(repos: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same split for exported repository metadata, on its `license` SPDX id column."""
    permissive = is_permissive(F.col("license"))
    allowed = repos.where(permissive | F.lit(dry_run))
    missing = F.coalesce(F.col("license"), F.lit("")) == ""
    reason = F.when(missing, "No license detected.").otherwise(
        F.format_string('License "%s" is not permissive.', F.col("license"))
    )
    return allowed, repos.where(~permissive & ~F.lit(dry_run)).select("repo_id", reason.alias("reason"))
