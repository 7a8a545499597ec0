"""Registry as JSON lines: scan with quarantine or strict rules, and the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions import json_values as js
from repoquarry.functions.text import strip_space
from repoquarry.operators.grouping import spread_join

# JSON key -> column, in the order the keys are written
FIELDS = (
    ("type", "type"),
    ("name", "name"),
    ("file", "file"),
    ("vsCodeAgent", "vs_code_agent"),
    ("description", "description"),
    ("category", "category"),
    ("triggers", "triggers"),
    ("isSubAgent", "is_sub_agent"),
    ("parentAgent", "parent_agent"),
    ("subAgents", "sub_agents"),
)


def registry_line() -> Column:
    """One JSON object per entry; absent optionals are left out."""
    return F.to_json(F.struct(*[F.col(column).alias(key) for key, column in FIELDS]))


def write_registry(registry: DataFrame, path: str, files: int | None = None, buckets: int = 256) -> None:
    """Write `(repo_id, ord, line)` as Parquet, partitioned by a hash bucket of `repo_id`.

    A bucket rather than the raw id keeps the number of directories fixed.  Rows are
    range-partitioned by (bucket, repo_id, ord), so a huge repository is split over several files.
    """
    bucket = F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).alias("bucket")
    lines = registry.select("repo_id", "ord", registry_line().alias("line"), bucket)
    keys = [F.col("bucket"), F.col("repo_id"), F.col("ord")]
    ranged = lines.repartitionByRange(files, *keys) if files else lines.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.partitionBy("bucket").parquet(path)


def registry_lines(files: DataFrame) -> DataFrame:
    """(repo_id, ord, line): the non-blank lines of registry files given as (repo_id, content)."""
    lines = F.filter(F.split(F.col("content"), "\n"), lambda line: strip_space(line) != "")
    return files.select("repo_id", F.posexplode(lines).alias("ord", "line")).withColumn(
        "ord", F.col("ord").cast("long")
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, ord, line) of registries written by `write_registry`, positions as written; blank lines are dropped."""
    lines = spark.read.schema("repo_id string, ord bigint, line string").parquet(path).where(strip_space(F.col("line")) != "")
    return lines.select("repo_id", "ord", "line")


def parse_registry(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, bad lines) from `(repo_id, ord, line)`; blank lines are neither.

    By default bad lines are set aside.  With `strict`, one bad line empties
    the whole registry it belongs to.
    """
    filled = lines.where(strip_space(F.col("line")) != "")
    parsed = js.with_json(filled, "line", "body")
    body = F.col("body")

    def text(key):
        return F.try_variant_get(body, f"$.{key}", "string")

    def texts(key):
        return F.try_variant_get(body, f"$.{key}", "array<string>")

    typed = parsed.select(
        "repo_id",
        "ord",
        "line",
        body.isNull().alias("bad"),
        text("type").alias("type"),
        text("name").alias("name"),
        text("file").alias("file"),
        text("vsCodeAgent").alias("vs_code_agent"),
        text("description").alias("description"),
        text("category").alias("category"),
        texts("triggers").alias("triggers"),
        text("parentAgent").alias("parent_agent"),
        texts("subAgents").alias("sub_agents"),
        F.try_variant_get(body, "$.isSubAgent", "boolean").alias("is_sub_agent"),
    )
    bad = typed.where("bad").select("repo_id", "ord", "line")
    entries = typed.where("NOT bad").drop("bad", "line")
    if strict:
        entries = spread_join(entries, bad.select("repo_id").distinct(), ["repo_id"], "ord", "left_anti")
    return entries, bad
