"""Tables stored in buckets of their entity: joins, lags and look-aheads along it start without a shuffle.

How a table lies is written into the metadata of its entity column, which parquet keeps; a reader in another session
registers the folder in its catalog from there. Each bucket is one file, sorted by entity and time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "panelloom.buckets"
_TIME = "panelloom.sorted_by"
_BY_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_colocated(df: DataFrame, path: str, entity: str = "permno", time: str = "month_id", buckets: int | None = None,
                    in_place: bool = False) -> str:
    """Store `df` in `buckets` buckets of `entity`, as many as shuffle partitions unless given; what `path` held is replaced.

    Tables that are to be joined need the same number; choose it so that a bucket fits a task. One shuffle, none with
    `in_place`: for rows that come from co-located tables and have not moved since. Rows that have would still be
    stored right, in more files. A missing entity is a value like others: all its rows are in one bucket.
    An empty table has no buckets, and becomes a plain folder that keeps the columns.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = df.select([F.col(f"`{c}`").alias(c, metadata={_KEY: buckets, _TIME: time}) if c == entity else F.col(f"`{c}`")
                        for c in df.columns])
    dealt = marked if in_place else marked.repartition(buckets, entity)
    name = _table_name(path, entity, time, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # leaves the files of a table that lies at a path
    (dealt.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
          .bucketBy(buckets, entity).sortBy(entity, time).saveAsTable(name))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    if not any(f.getPath().getName().startswith("part-") for f in files):
        spark.sql(f"DROP TABLE {name}")
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return path


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path`; one that was not stored by `write_colocated` is read as plain parquet."""
    plain = spark.read.parquet(path)
    marked = [f for f in plain.schema if _KEY in f.metadata]
    if len(marked) != 1:
        return plain
    entity, buckets, time = marked[0].name, marked[0].metadata[_KEY], marked[0].metadata[_TIME]
    name = _table_name(path, entity, time, buckets)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    if spark.catalog.tableExists(name) and spark.table(name).dtypes != plain.dtypes:
        spark.sql(f"DROP TABLE {name}")
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{entity}`) "
              f"SORTED BY (`{entity}`, `{time}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _table_name(path: str, entity: str, time: str, buckets: int) -> str:
    return "panelloom_" + hashlib.md5(f"{path.rstrip('/')}|{entity}|{time}|{buckets}".encode()).hexdigest()


@contextmanager
def joins_by_entity(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside the block join on (entity, time) without moving tables that lie by entity alone.

    Spark asks for a partitioning by all keys of a join unless told otherwise, so that a frequent key is spread; an
    entity's rows are bounded by the calendar.
    """
    before = spark.conf.get(_BY_ALL_KEYS, None)
    spark.conf.set(_BY_ALL_KEYS, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BY_ALL_KEYS)
        else:
            spark.conf.set(_BY_ALL_KEYS, before)
