"""Shared working folder: lineage cuts and intermediate tables.

A cluster names the folder in ``spark.checkpoint.dir``.  Where it is unset, a
folder below the warehouse is used, on every master alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_working"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table that several later jobs read, and read it back.

    Later readers prune columns and push filters into the written Parquet
    instead of running the plan above it again.
    """
    path = fresh_path(df.sparkSession, name)
    for scope in _SCOPES:
        scope.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, at the end, every table that ``stage`` writes inside.

    Only for work whose results are written or collected before the scope ends:
    a lazy DataFrame that leaves it still reads its tables.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete through Hadoop's file system, which serves every kind of store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
