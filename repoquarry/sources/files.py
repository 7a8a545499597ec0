"""File inventories: from a directory of repositories, or from an existing table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.functions import paths
from repoquarry.operators.grouping import number_sorted
from repoquarry.plans.storage import settle

FILES_SCHEMA = (
    "repo_id string, ord bigint, path string, ext string, size bigint, "
    "is_test boolean, is_config boolean, content string"
)


READ_BYTES = 128 << 20  # content read by one task, about
BATCH_BYTES = 8 << 20


def _uri(root: str) -> str:
    """A root as pyarrow's file systems take it: a URI with an authority, or an absolute path."""
    scheme, rest = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?(.*)", root, re.S).groups()
    if not rest.startswith("/"):
        raise ValueError(f"not an absolute path: {root}")
    scheme = scheme or ""
    if scheme and "//" not in scheme:
        scheme += "//"
    return scheme + (re.sub("/+", "/", rest).rstrip("/") or "/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """`(repo_id, path, size)` of every file below `root/<repo_id>/`, listed folder by folder on the executors.

    The folders of one depth are listed by one job, and its result is stored; the driver sees no path.  Folders that can't be
    read are empty, entries that are neither file nor folder are left out, and so are files beside the repositories.
    """
    uri = _uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    found = system.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                except OSError:
                    continue
                found = [entry for entry in found if entry.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder}/{entry.base_name}".lstrip("/") for entry in found], pa.string()),
                     pa.array([entry.type == fs.FileType.Directory for entry in found], pa.bool_()), pa.array([entry.size for entry in found], pa.int64())],
                    names=["place", "is_folder", "size"],
                )

    levels, folders = [], spark.createDataFrame([("",)], "place string")
    while True:
        level = settle(folders.mapInArrow(run, "place string, is_folder boolean, size bigint"), "listing")
        levels.append(level.where("NOT is_folder AND instr(place, '/') > 0"))
        below = level.where("is_folder").select("place")
        if below.isEmpty():
            break
        folders = below.repartition("place")
    repo = F.substring_index("place", "/", 1)
    path = F.substr("place", F.instr("place", F.lit("/")) + 1)
    return reduce(lambda a, b: a.unionByName(b), levels).select(repo.alias("repo_id"), path.alias("path"), "size")


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """Add `content` to rows `(repo_id, path, size, ...)` by reading each file where its row is; unreadable files lose their row.

    The rows are dealt over tasks of about `READ_BYTES`; contents are never shuffled.  Bytes that are not UTF-8 become U+FFFD.
    """
    uri, names = _uri(root), listed.columns
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    at, path_at = names.index("repo_id"), names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            kept, held, size = [], [], 0
            for row, (repo, path) in enumerate(zip(batch.column(at).to_pylist(), batch.column(path_at).to_pylist(), strict=True)):
                try:
                    with system.open_input_stream(f"{base}/{repo}/{path}") as source:
                        held.append(source.read().decode("utf-8", "replace"))
                except OSError:
                    continue
                kept.append(row)
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(held, pa.string())], names=[*names, "content"])
                    kept, held, size = [], [], 0
            if kept:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(held, pa.string())], names=[*names, "content"])

    tasks = max(total // READ_BYTES + 1, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return listed.repartition(tasks, "repo_id", "path").mapInArrow(run, f"{types}, content string")


def scan_repositories(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Raw `(repo_id, ord, path, size, content)` of every file below `root/<repo_id>/`.

    `root` is an absolute path or a URI of a store that pyarrow's file systems open on every executor.  Names that start with a dot
    or an underscore count as any other.  `ord` is the place of the path among the sorted paths of its repository, from 0,
    so two scans of the same files agree, however they are split.  Files that are gone or can't be read when their
    content is wanted are left out.  The listing is made and numbered when this is called.
    """
    listed = number_sorted(list_files(spark, root), ["repo_id"], ["path"], "ord").select("repo_id", "ord", "path", "size")
    return read_files(listed, root) if with_content else listed


def write_files(files: DataFrame, root: str) -> int:
    """Write `(repo_id, path, content)` as one file each, `root/<repo_id>/<path>`; returns how many.

    `root` is a URI or an absolute path on storage that all executors share.  A null content is an empty file; of rows that
    share a path one stays.  A task that runs again writes the same files again.
    """
    root = _uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for repo, path, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                target = f"{base}/{repo}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    return files.select("repo_id", "path", "content").mapInArrow(run, "written bigint").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def inventory(raw: DataFrame, mode: str = "local", include_dotfiles: bool = False) -> DataFrame:
    """Apply the ignore rules and add `ext`, `is_test`, `is_config`.

    `local` skips files without a size (unreadable) and, unless asked for, every
    path with a hidden segment; `remote` keeps only entries of type `file` when
    the table has a `type` column, and marks nothing as hidden.
    """
    path = F.col("path")
    kept = raw.where(~paths.is_ignored(path, mode))
    if mode == "local":
        kept = kept.where(F.col("size").isNotNull())
        if not include_dotfiles:
            kept = kept.where(~paths.is_hidden(path))
    elif "type" in raw.columns:
        kept = kept.where(F.col("type") == "file")
    extension = paths.local_extension(path) if mode == "local" else paths.remote_extension(path)
    return (
        kept.withColumn("ext", extension)
        .withColumn("is_test", paths.is_test(path))
        .withColumn("is_config", paths.is_config(path))
    )
