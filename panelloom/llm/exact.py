"""Exact duplicates by a stream whose state, kept on disk without expiry, remembers every text that was ever seen.

The state is keyed by the digest of the normalised text and retains, for each, the least (doc_id, place of its row in the
files) and how many rows had it. A digest alone decides nothing: every hit is read again, and so is the row that the
retained place points to; their whole texts are compared, and those that differ are grouped by the text itself.

A run goes on where the last one of the same state folder ended and reads new files only. Everything is DataFrame and
Structured Streaming code; no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import join_groups, maybe_in
from panelloom.sources.storage import materialize, scratch_path

#: One trigger takes new files of about so many bytes.
TRIGGER_BYTES = 1 << 40

_STATE = "spark.sql.streaming.stateStore"
#: RocksDB on the executors' disks, changes in the shared folder after every trigger; memory bounded for each executor, no
#: space taken in advance (some MB for each of many small partitions).
_SETTINGS = {f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
             f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
             f"{_STATE}.rocksdb.allowFAllocate": "false",
             f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
             f"{_STATE}.rocksdb.maxMemoryUsageMB": "256"}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The state's settings, for what writes or reads it inside the block."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(table: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text normalised, digest, file, row) of a table read from files."""
    place = table.metadataColumn("_metadata")
    text = normalised(F.col("text"))
    return table.select("doc_id", text.alias("text"), digest(text).alias("digest"), place["file_path"].alias("file"), place["row_index"].alias("row"))


def _least() -> Column:
    """The row that stays: the least doc_id, null after all others, and of equal ones the first in the files."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row"))


def remember(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, trigger_bytes: int = TRIGGER_BYTES) -> None:
    """Streams the files of the parquet table at `path` that `state` hasn't seen yet into it, and ends.

    The last letter stands in brackets: as a pattern, a table of one file is as good as a folder.
    """
    rows = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(trigger_bytes))
            .parquet(f"{path[:-1]}[{path[-1]}]"))
    seen = _located(rows, digest).groupBy("digest").agg(_least().alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(spark):
        query = (seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
    query.awaitTermination()


def remembered(spark: SparkSession, state: str) -> DataFrame:
    """What the state holds, stored as a table: digest, keep_id, keep_file, keep_row and the number n of rows."""
    with _settings(spark):
        held = spark.read.format("statestore").load(state)
        keep, n = held.schema["value"].dataType.names
        keep = F.col("value")[keep]
        return materialize(held.select(
            F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["file"].alias("keep_file"),
            keep["row"].alias("keep_row"), F.col("value")[n].alias("n")), "seen-groups")


def exact_duplicates(spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256,
                     trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """One line per row of the parquet table at `path`: doc_id, keep_id, keep_file, keep_row, group_size, kept, text_sha256.

    Texts are equal when they are after `normalised`; null is empty and equal to it and to nothing else. Of equal ones the row with
    the least doc_id stays, null ids after all others; of rows repeated with one doc_id exactly one stays. Very long texts
    are compared whole, columns besides doc_id and text are not read whatever their names, and an empty table gives no rows. `state` is the
    folder of an earlier run over the same table, which then reads only files added since.

    Texts move once, and only those whose digest was seen twice. A text that more than one row in HEAVY_SHARE has is
    broadcast to its copies: all such texts together are at most HEAVY_SHARE times the mean text.
    """
    state = state or scratch_path(spark, "seen-texts")
    remember(spark, path, state, digest, trigger_bytes)
    groups = remembered(spark, state)
    several = groups.filter("n > 1")
    flagged = maybe_in(_located(spark.read.parquet(path), digest), several.select("digest"), "digest", "hit")
    rows = materialize(flagged.select("doc_id", "digest", "file", "row", F.sha2("text", 256).alias("text_sha256"),
                                      F.when(F.col("hit"), F.col("text")).alias("text")), "seen-rows")
    total = rows.count()
    narrow = rows.drop("text")
    placed = join_groups(narrow, groups.withColumn("group_size", F.col("n")), "digest", "n", total)

    hits = rows.filter(F.col("text").isNotNull())
    at_place = hits.select("digest", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("text").alias("kept_text"))
    retained = at_place.join(several.select("digest", "keep_file", "keep_row", "n"), ["digest", "keep_file", "keep_row"]).select("digest", "kept_text", "n")
    unlike = materialize(join_groups(hits, retained, "digest", "n", total).filter(F.col("text") != F.col("kept_text")).drop("kept_text"),
                         "seen-unlike")
    if not unlike.isEmpty():
        placed = _regrouped(placed, unlike)
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return placed.select("doc_id", "keep_id", "keep_file", "keep_row", "group_size", kept.alias("kept"), "text_sha256")


def _regrouped(placed: DataFrame, unlike: DataFrame) -> DataFrame:
    """Rows whose text isn't that of the row their digest retains: groups of their own, taken off the others' sizes."""
    own = unlike.groupBy("digest", "text").agg(_least().alias("least"), F.count(F.lit(1)).alias("size"))
    found = unlike.join(own, ["digest", "text"]).select(
        "file", "row", F.col("least.doc_id").alias("own_id"), F.col("least.file").alias("own_file"), F.col("least.row").alias("own_row"), "size")
    fewer = unlike.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    joined = placed.join(found, ["file", "row"], "left").join(fewer, "digest", "left")
    other = F.col("size").isNotNull()
    return joined.select(
        "doc_id", "file", "row", "text_sha256",
        *[F.when(other, F.col(f"own_{c}")).otherwise(F.col(f"keep_{c}")).alias(f"keep_{c}") for c in ("id", "file", "row")],
        F.coalesce("size", F.col("group_size") - F.coalesce("fewer", F.lit(0))).alias("group_size"))


ORACLE_SQL = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n"""
