"""Cutting lineage: intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor reaches."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; remembered while `scratch` is open, so that it can be deleted."""
    path = f"{shared_folder(spark).rstrip('/')}/panelloom-{label}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was stored inside the block when it ends: for runs whose results are stored elsewhere."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Unlike a cache it survives lost executors, and unlike a checkpointed RDD the copy keeps
    column pruning, filter pushdown and (with `partition_by`) partition pruning. Rows are
    rebalanced before a partitioned write: few files per folder, and a large folder is still
    written by many tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
