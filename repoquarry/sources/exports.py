"""Exported repository metadata, git trees and file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = "owner string, repo string, default_branch string, license struct<spdx_id:string>"
TREE_SCHEMA = "repo_id string, tree array<struct<path:string,type:string,size:bigint,sha:string>>"
CONTENT_SCHEMA = "repo_id string, path string, encoding string, content string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return repo_metadata(spark.read.schema(META_SCHEMA).json(path))


def repo_metadata(exports: DataFrame) -> DataFrame:
    """(repo_id, owner, repo, default_branch, license): the SPDX id or NULL."""
    return exports.select(
        F.concat_ws("/", "owner", "repo").alias("repo_id"),
        "owner",
        "repo",
        "default_branch",
        F.col("license.spdx_id").alias("license"),
    )


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    return git_tree(spark.read.schema(TREE_SCHEMA).json(path))


def git_tree(exports: DataFrame) -> DataFrame:
    """(repo_id, ord, path, type, size, sha) of blobs and trees; other entry types are dropped."""
    items = exports.select("repo_id", F.posexplode("tree").alias("ord", "item"))
    kind = F.when(F.col("item.type") == "blob", "file").when(F.col("item.type") == "tree", "dir")
    return items.select(
        "repo_id",
        F.col("ord").cast("long").alias("ord"),
        F.col("item.path").alias("path"),
        kind.alias("type"),
        F.col("item.size").alias("size"),
        F.col("item.sha").alias("sha"),
    ).where(F.col("type").isNotNull())


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CONTENT_SCHEMA).json(path)
    return raw.select("repo_id", "path", decode_content(F.col("encoding"), F.col("content")).alias("content"))


def decode_content(encoding: Column, content: Column) -> Column:
    """Text of an exported file: base64 decoded, otherwise as is; '' when there is none."""
    standard = F.translate(F.regexp_replace(content, r"[^A-Za-z0-9+/=_-]", ""), "-_", "+/")
    decoded = F.make_valid_utf8(F.try_to_binary(standard, F.lit("base64")).cast("string"))
    return F.coalesce(F.when(encoding == "base64", decoded).otherwise(content), F.lit(""))
