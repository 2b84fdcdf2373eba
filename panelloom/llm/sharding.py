"""Longest-processing-time sharding: groups that stay together, largest first, each to the least loaded shard.

The heap runs over everything that can decide the balance. Groups above a share of the whole, few by that very bound,
are dealt one by one. The rest are dealt by size class: sizes with the same leading bits, at most some ten thousand
classes for any corpus. A class of equal items is dealt as the heap would deal it, in one step: the least loaded
shards are filled up to a common level. Every group then looks up its shard by its number inside its class.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import crc32_of_text, join_groups, number_rows
from panelloom.sources.storage import materialize

SHARDS = 8
#: A group with more than one byte (or row) in this many is dealt one by one; so 2 * ALONE groups at most.
ALONE = 1 << 13
#: Leading bits that sizes of one class share: sizes below 2 ** CLASS_BITS are exact.
CLASS_BITS = 11


def size_class(size: Column) -> Column:
    """The size with all but its CLASS_BITS leading bits cleared; below one part in a thousand less."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - CLASS_BITS)
    return size - size % F.pow(F.lit(2.0), drop).cast("long")


def level(loads: list[float], size: float, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets when each goes to the least loaded shard.

    Whole rounds are dealt in one step up to the level they lead to; a heap deals what is left, fewer than two rounds.
    """
    shards = len(loads)
    given = [0] * shards
    if count > 4 * shards:
        order = sorted(range(shards), key=lambda s: loads[s])
        for used in range(shards, 0, -1):  # the shards below the final level are the least loaded ones
            own = order[:used]
            high = (sum(loads[s] for s in own) + size * (count - 2 * used)) / used
            if high >= loads[own[-1]]:
                for s in own:
                    given[s] = max(0, int((high - loads[s]) // size))
                break
    heap = [(loads[s] + given[s] * size, s) for s in range(shards)]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, s = heapq.heappop(heap)
        given[s] += 1
        heapq.heappush(heap, (load + size, s))
    return given


def deal(large: list[tuple[object, int]], classes: list[tuple[int, int, int]], shards: int):
    """Shards of the large groups (key, size) and, for each class (size, groups, bytes), how many go to each shard."""
    events = [(size, 0, key, 1, size) for key, size in large] + [(b / n, 1, c, n, b) for c, n, b in classes]
    events.sort(key=lambda e: (-e[0], e[1], repr(e[2])))
    loads, alone, quota = [0.0] * shards, {}, {}
    for size, is_class, key, count, _ in events:
        given = level(loads, size, count)
        if is_class:
            quota[key] = given
        else:
            alone[key] = given.index(1)
        for s in range(shards):
            loads[s] += given[s] * size
    return alone, quota


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and the group, a digest of the text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       crc32_of_text(F.col("text")).alias("text_crc32"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("_group"))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of `docs` (doc_id, text) in a shard: doc_id, size, text_crc32, shard, slot.

    Rows of equal text stay together, a null text counts as an empty one, repeated rows are rows of one group, a null
    doc_id stays null, other columns are ignored, an empty table gives no rows. Slots number each shard's rows from 0
    without gaps. Loads differ by no more than one group would, but for groups above an even share.
    """
    spark = docs.sparkSession
    rows = materialize(sizes(docs), "sizes")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n"))
    groups = materialize(groups.withColumn("_class", size_class(F.col("_size"))), "groups")
    is_large = (F.col("_size") * ALONE > total["bytes"]) | (F.col("_n") * ALONE > total["n"])
    large = [(bytes(r["_group"]), r["_size"]) for r in groups.filter(is_large).select("_group", "_size").collect()]
    classes = [tuple(r) for r in groups.filter(~is_large).groupBy("_class").agg(
        F.count(F.lit(1)), F.sum("_size")).collect()]
    alone, quota = deal(large, classes, shards)
    fixed = spark.createDataFrame([(bytearray(k), s) for k, s in alone.items()], "_group binary, shard int")
    ends = spark.createDataFrame([(c, [int(x) for x in np.cumsum(q)]) for c, q in quota.items()],
                                 "_class long, _ends array<long>")
    numbered = number_rows(groups.filter(~is_large).select("_group", "_n", "_class"), ["_class"], "_number", "classes")
    # one line for each size class, bounded by CLASS_BITS
    small = numbered.join(F.broadcast(ends), "_class").select(
        "_group", "_n", F.size(F.filter("_ends", lambda e: e <= F.col("_number"))).cast("int").alias("shard"))
    placed = (rows.join(F.broadcast(fixed), "_group")
              .unionByName(join_groups(rows.join(F.broadcast(fixed.select("_group")), "_group", "left_anti"),
                                       small, "_group", "_n", total["n"])))
    return number_rows(placed.drop("_group"), ["shard"], "slot", "shards")
