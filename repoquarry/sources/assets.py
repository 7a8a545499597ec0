"""Document tables: write rendered assets, and pick assets out of a file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.operators.documents import INSTRUCTIONS_PATH, MANAGED_TAG, asset_bucket, merge_text
from repoquarry.plans.storage import StageStore, exists

ASSETS_SCHEMA = "repo_id string, path string, content string"
SKILL_PATH = r"^\.github/skills/([^/]+)/"
SKILL_FILE = r"^\.github/skills/([^/]+)/SKILL\.md\z"
AGENT_PATH = r"^\.github/agents/([^/]+\.agent\.md)\z"
HOOK_PATH = r"^\.github/hooks/([^/]+\.ya?ml)\z"
REGISTRY_PATH = "skills-registry.jsonl"


def write_assets(assets: DataFrame, path: str, dry_run: bool = False, buckets: int = 256) -> DataFrame:
    """Write `(repo_id, path, content)` as Parquet, partitioned by a hash bucket of `repo_id`.

    A bucket rather than the raw id keeps the number of directories fixed; a
    reader prunes with `bucket = pmod(xxhash64(repo_id), buckets)`.  A table rendered
    for the same number of buckets has that column, and is written in the order in which
    it comes; any other is sorted by bucket within its tasks.  A dry run only returns the table.
    """
    if not dry_run:
        bucket = F.col("bucket") if "bucket" in assets.columns else _bucket(buckets)
        assets.select("repo_id", "path", "content", bucket).write.partitionBy("bucket").parquet(path)
    return assets


def _bucket(buckets: int) -> Column:
    return asset_bucket(buckets).alias("bucket")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, path, content, bucket) of stored assets."""
    return spark.read.schema(f"{ASSETS_SCHEMA}, bucket bigint").parquet(path)


def _replace_buckets(rows: DataFrame, path: str) -> None:
    # a repository may fill its bucket, so a bucket's rows are dealt by their paths as well
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_assets(
    assets: DataFrame, path: str, buckets: int = 256, managed: Column | None = None, tag: str = MANAGED_TAG
) -> list[int]:
    """Bring stored assets up to date with `(repo_id, path, content)`; the buckets that were rewritten, in order.

    A row replaces the stored one of its path, or is added.  Where `managed` holds, by default for the instructions
    document, the new text is a block that is spliced into the stored text instead.  Stored rows without a new one
    stay.  Only buckets of repositories in `assets` are read, and only those in which a text changes are written, so the same
    assets again write nothing.  `assets` has one row per path, `buckets` is the number the table was written with.

    The new buckets are first written whole beside the table, under `_pending`; from then on the upsert
    is decided.  A call that breaks off while it replaces them is finished by the next one, before anything else.
    """
    spark, path = assets.sparkSession, path.rstrip("/")
    pending = StageStore(spark, f"{path}/_pending")
    if pending.has("rows"):
        _replace_buckets(read_assets(spark, f"{pending.path}/rows"), path)
        pending.discard()
    new = assets.select("repo_id", "path", F.col("content").alias("new"), _bucket(buckets), F.lit(True).alias("given"))
    old = read_assets(spark, path) if exists(spark, path) else spark.createDataFrame([], f"{ASSETS_SCHEMA}, bucket bigint")
    # at most `buckets` numbers
    named = [row[0] for row in new.select("bucket").distinct().collect()]
    old = old.where(F.col("bucket").isin(named)).withColumnRenamed("content", "old").withColumn("stored", F.lit(True))
    both = old.join(new, ["bucket", "repo_id", "path"], "full")
    spliced = F.col("path") == INSTRUCTIONS_PATH if managed is None else managed
    text = F.when(F.col("given").isNull(), F.col("old")).when(spliced, merge_text(F.col("old"), F.col("new"), tag)).otherwise(F.col("new"))
    rows = both.select("repo_id", "path", text.alias("content"), "bucket", "old", "stored")
    differs = F.col("stored").isNull() | ~F.col("content").eqNullSafe(F.col("old"))
    changed = sorted(row[0] for row in rows.where(differs).select("bucket").distinct().collect())
    if changed:
        whole = rows.where(F.col("bucket").isin(changed)).select("repo_id", "path", "content", "bucket")
        _replace_buckets(pending.keep(whole, "rows"), path)
        pending.discard()  # not reached when the replacement breaks off
    return changed


def skill_assets(files: DataFrame) -> DataFrame:
    """(repo_id, name, content): one row per skill directory; content NULL without a SKILL.md."""
    name = F.regexp_extract("path", SKILL_PATH, 1)
    inside = files.where(F.col("path").rlike(SKILL_PATH)).select("repo_id", "path", "content", name.alias("name"))
    is_document = F.col("path") == F.concat(F.lit(".github/skills/"), F.col("name"), F.lit("/SKILL.md"))
    return inside.groupBy("repo_id", "name").agg(F.max(F.when(is_document, F.col("content"))).alias("content"))


def agent_assets(files: DataFrame) -> DataFrame:
    """(repo_id, name, content) of the agent documents."""
    name = F.regexp_extract("path", AGENT_PATH, 1)
    return files.where(F.col("path").rlike(AGENT_PATH)).select("repo_id", name.alias("name"), "content")


def hook_assets(files: DataFrame) -> DataFrame:
    """(repo_id, name, content) of the hook files."""
    name = F.regexp_extract("path", HOOK_PATH, 1)
    return files.where(F.col("path").rlike(HOOK_PATH)).select("repo_id", name.alias("name"), "content")


def registry_assets(files: DataFrame) -> DataFrame:
    """(repo_id, content) of the registry files."""
    return files.where(F.col("path") == REGISTRY_PATH).select("repo_id", "content")
