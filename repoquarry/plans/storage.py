"""Shared working storage for intermediate results and stream progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where that is unset, a folder beside the warehouse is taken if everything
    runs in one process (`local` masters, as in tests); on a cluster the
    missing setting is an error, because executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_working"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def working_dir(spark: SparkSession, name: str, root: str | None = None) -> str:
    """Path of a fresh folder below `root`, or below the shared folder of the cluster."""
    return f"{(root or shared_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled", root: str | None = None) -> DataFrame:
    """Write a result that several tables are derived from once, and read it back.

    The copy lies on shared storage, so it outlives any executor and cuts the
    lineage of everything built on it.  `discard` removes it.
    """
    path = working_dir(df.sparkSession, name, root)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, path: str) -> None:
    """Delete a working folder made by `working_dir` or `settle`."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    system, target = _file_system(spark, path)
    return system.exists(target)


class StageStore:
    """Results of one flow on shared storage, each written once by name and shared by all tables derived from it.

    The store owns its folder.  `discard`, or the end of its `with` block, removes it; with `at_exit` it is removed when
    the application ends, for results that are read later than the code that asked for them returns.  A store opened on
    the `path` of an earlier one goes on from there: stages that were written whole are read, others are written anew.
    A stage's name stands for its input, so a changed input needs another name or another store.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, at_exit: bool = False) -> None:
        self.spark = spark
        self.path = (path or working_dir(spark, "stages")).rstrip("/")
        if at_exit:
            system, target = _file_system(spark, self.path)
            system.mkdirs(target)  # only a folder that is there can be marked
            system.deleteOnExit(target)

    def _place(self, name: str) -> str:
        if not name or name.startswith(("_", ".")) or "/" in name:
            raise ValueError(f"not a name of a stage: {name!r}")
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        """Whether the stage was written whole: its marker is the last file of a write."""
        return exists(self.spark, f"{self._place(name)}/_SUCCESS")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The stage `name`, written from `df` unless it is there already."""
        if not self.has(name):
            df.write.mode("overwrite").parquet(self._place(name))
        return self.spark.read.schema(df.schema).parquet(self._place(name))

    def discard(self, name: str | None = None) -> None:
        """Remove one stage, or the whole store."""
        discard(self.spark, self.path if name is None else self._place(name))

    def __enter__(self) -> StageStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.discard()
