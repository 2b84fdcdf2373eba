"""Helpers shared by the text operators: gapless numbering, joins to groups, Arrow text as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.sources.shipping import ship
from panelloom.sources.storage import materialize

__all__ = ["HEAVY_SHARE", "crc32_of_text", "fresh_name", "join_groups", "maybe_in", "number_rows", "release", "ship", "slices", "utf8"]

#: A group is heavy if it holds more than one row in this many; so many groups at most are heavy.
HEAVY_SHARE = 1024


def release() -> None:
    """Gives back what a finished task has freed: a Python worker that is used again by the next stage starts small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh_name(columns: list[str], name: str) -> str:
    """`name`, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_rows(df: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... without gaps inside each value of `keys` (not null).

    The rows are written once with the id of the task that wrote them; a task's rows of one key are
    numbered among themselves and shifted by the counts of the tasks before. So a key that holds
    most rows is still numbered by many tasks.
    """
    wrote = materialize(df.withColumn("_id", F.monotonically_increasing_id()), label)
    wrote = wrote.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (wrote.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_id")) - 1
    return (wrote.withColumn("_local", local).join(first, [*keys, "_part"])
            .withColumn(name, (F.col("_first") + F.col("_local")).cast("long"))
            .drop("_id", "_part", "_local", "_first"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: str, total: int) -> DataFrame:
    """`rows` with the columns of their group in `groups` (one line per `key`, `n_rows` rows each).

    Heavy groups, HEAVY_SHARE at most, are broadcast; the others meet their rows in a shuffle in
    which no key has more than a HEAVY_SHARE-th of the rows. Rows without a group are dropped.
    """
    is_heavy = F.col(n_rows) * HEAVY_SHARE > total
    heavy, light = groups.filter(is_heavy).drop(n_rows), groups.filter(~is_heavy).drop(n_rows)
    known = F.broadcast(heavy)
    return (rows.join(known, key)
            .unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)))


#: Bits of a membership filter: 64 in a row, so that its table has so many rows at most whatever it holds.
FILTER_BITS = 1 << 23


def maybe_in(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """`df` with a boolean column: false only where `key` is surely not in `keys`; null keys are in none.

    The filter is one bit for a hash of each key, gathered by the executors into FILTER_BITS / 64 rows, which bounds the
    broadcast. The more keys there are, the more rows are let through for nothing: an exact join has to follow.
    """
    def place(column):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    bits = (keys.filter(F.col(key).isNotNull()).select(place(key).alias("_at"))
            .groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 AS int))")).alias("_bits")))
    joined = df.withColumn("_at", place(key)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bits), "_word", "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_at & 63 AS int)) & 1 = 1, false)") & F.col(key).isNotNull()
    return joined.withColumn(flag, hit).drop("_at", "_word", "_bits")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them (one more entry than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most_bytes: int = 4 << 20):
    """Consecutive row ranges (first, last) of a string column with about `most_bytes` of text, one row at least."""
    _, at = utf8(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1)
        yield first, min(last, len(column))
        first = min(last, len(column))


def crc32_of_text(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
