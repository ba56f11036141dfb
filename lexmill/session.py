"""Session helpers: shared scratch folders and materialisation that survives lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, a laptop) a temporary folder is created and set; a cluster without
    the setting is an error, as its executors would not see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder, in that of the application."""
    path = f"{shared_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written within are deleted at the end: results that still read one have to be written before, to a
    path from without."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that have not been written yet are lost with them."""
    delete_path(spark, f"{shared_dir(spark)}/lexmill/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, holds no executor-local state."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(target)] if store.exists(target) else []


class Scratch:
    """Tables that one computation writes to the shared folder; those it no longer needs it can drop."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose results have been written; a plan that still reads one would fail."""
        for t in tables:
            delete_path(self.spark, self.held.pop(id(t))[1])
