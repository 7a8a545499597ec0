"""Representative files per repository: rank on metadata first, read content afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoquarry import rules
from repoquarry.functions import paths
from repoquarry.functions.text import any_of
from repoquarry.operators.grouping import top_k_per_group


def sample_files(files: DataFrame, sep: str = "/") -> DataFrame:
    """(repo_id, ord, path, size, rank): up to 20 non-test files, configuration and shallow ones first.

    The cut to 20 comes before the size filter, so an oversized file uses up a place.
    """
    columns = files.where(~F.col("is_test")).select(
        "repo_id", "ord", "path", "size", "is_config", paths.depth(F.col("path"), sep).alias("depth")
    )
    order = [F.col("is_config").desc(), F.col("depth"), F.col("ord")]
    ranked = top_k_per_group(columns, ["repo_id"], order, rules.SAMPLE_FILES, ["ord"])
    return ranked.where(F.col("size") <= rules.SAMPLE_MAX_SIZE).select("repo_id", "ord", "path", "size", "rank")


def priority_files(files: DataFrame) -> DataFrame:
    """(repo_id, ord, path, size, rank): well-known files first, then shallow sources, 15 in all.

    Only the first match of each well-known name counts; when that one is too
    large no later match replaces it.
    """
    path, size = F.col("path"), F.coalesce(F.col("size"), F.lit(0))
    names = list(enumerate(rules.PRIORITY_NAMES))

    def hit(name):
        return (path == name) | path.endswith("/" + name)

    slot = reduce(lambda acc, item: acc.when(hit(item[1]), item[0]), names[1:], F.when(hit(names[0][1]), names[0][0]))
    columns = files.select("repo_id", "ord", "path", size.alias("size"), slot.alias("slot"))
    known = (
        columns.where(F.col("slot").isNotNull())
        .groupBy("repo_id", "slot")
        .agg(F.min(F.struct("ord", "path", "size")).alias("f"))
        .where(F.col("f.size") < rules.PRIORITY_MAX_SIZE)
        .select("repo_id", F.col("f.ord").alias("ord"), F.col("f.path").alias("path"), F.col("f.size").alias("size"),
                F.lit(0).alias("tier"), F.col("slot").cast("long").alias("place"))
    )
    is_source = any_of([path.endswith(ext) for ext in rules.PRIORITY_SOURCE_EXTENSIONS])
    sources = (
        columns.where(is_source & (F.col("size") < rules.PRIORITY_MAX_SIZE))
        .select("repo_id", "ord", "path", "size", F.lit(1).alias("tier"), paths.depth(path).alias("place"))
    )
    # enough sources to fill every place even if each well-known file is one of them
    enough = rules.PRIORITY_FILES + len(rules.PRIORITY_NAMES)
    sources = top_k_per_group(sources, ["repo_id"], [F.col("place"), F.col("ord")], enough, ["ord"]).drop("rank")
    # at most 29 rows per repository from here on
    same_file = Window.partitionBy("repo_id", "path").orderBy("tier")
    order = Window.partitionBy("repo_id").orderBy("tier", "place", "ord")
    merged = known.unionByName(sources).withColumn("copy", F.row_number().over(same_file)).where("copy = 1")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.PRIORITY_FILES)
    return ranked.select("repo_id", "ord", "path", "size", "rank")


def first_paths(files: DataFrame, n: int = rules.PROMPT_PATHS) -> DataFrame:
    """(repo_id, paths): the first `n` paths of each repository, one per line."""
    ranked = top_k_per_group(files.select("repo_id", "ord", "path"), ["repo_id"], [F.col("ord")], n, ["ord"])
    pairs = F.array_sort(F.collect_list(F.struct("rank", "path")))  # at most n
    joined = F.array_join(F.transform(pairs, lambda p: p["path"]), "\n")
    return ranked.groupBy("repo_id").agg(joined.alias("paths"))


def attach_content(picked: DataFrame, contents: DataFrame) -> DataFrame:
    """Join `content` back onto picked files by (repo_id, ord): late materialisation.

    The key is one file, so a hot repository spreads over all partitions, and
    the small picked side prunes the content side before any shuffle (a
    broadcast when Spark finds it small, a runtime bloom filter otherwise).
    """
    return picked.join(contents.select("repo_id", "ord", "content"), ["repo_id", "ord"])
