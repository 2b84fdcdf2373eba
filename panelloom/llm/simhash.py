"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked through shared blocks of bits.

Two fingerprints that differ in at most `distance` of their bits agree on all bits of at least B - distance of B
blocks. Each fingerprint is put under every choice of B - distance blocks; pairs meet under a shared choice and are
verified by their Hamming distance, so no pair is lost and none is false. B follows from the number of different
fingerprints: more blocks mean longer keys and keep the buckets small, the links are the same for every B.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import fresh_name, join_groups, release, ship, slices, utf8
from panelloom.llm.components import components
from panelloom.sources.storage import materialize

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints under one key that one task compares with each other; a larger bucket goes through shared midpoints.
BUCKET = 1 << 16
#: Buckets up to this size are compared side by side, larger ones are searched from member to member.
SMALL = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: set where more than half the hashes of the text's shingles, repeats included, have a one."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    view = memoryview(joined)
    hashes = np.array([xxh64_intdigest(view[a:b], SEED) for a, b in zip(begins, ends[shingle - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k: k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null and empty texts have 0."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1), 8 << 20):
                part = batch.slice(first, last - first)
                raw, at = utf8(part.column(1))
                text = raw.tobytes()
                fps = np.array([fingerprint(text[a:b], shingle) for a, b in itertools.pairwise(at.tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        release()

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def block_masks(count: int, distance: int) -> list[int]:
    """For B blocks, the smallest B that suits `count` fingerprints: the bit masks of every choice of B - distance."""
    for blocks in range(distance + 2, 33):
        if 64 * (blocks - distance) // blocks >= math.log2(count + 1) + 2:
            break
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(choice) for choice in itertools.combinations(one, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _near(bucket: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (root, member) that connect what is linked inside a bucket of different fingerprints: fewer than members."""
    unseen = bucket
    while len(unseen) > 1:
        root, unseen = unseen[0], unseen[1:]
        front = [root]
        while front and len(unseen):
            close = np.bitwise_count(unseen ^ front.pop()) <= distance
            found = unseen[close]
            if len(found):
                unseen = unseen[~close]
                front.extend(found)
                yield np.full(len(found), root), found


def _links_of(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key; a bucket's links connect it but need not name every pair."""
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(edge, len(keys)))
    u, v = [], []
    for start, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
        for a, b in _near(np.unique(fps[start: start + n]), distance):
            u.append(a)
            v.append(b)
    little = np.repeat(size <= SMALL, size)
    k, f = keys[little], fps[little]
    for step in range(1, SMALL):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b = f[:-step][same], f[step:][same]
        close = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        u.append(a[close])
        v.append(b[close])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *u]), np.concatenate([empty, *v])


def _bucket_links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links from buckets of bounded size; a bucket's rows come together, several buckets to a task."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
                fps = np.append(fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if not len(keys):
                continue
            whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))  # the last may go on
            u, v = _links_of(keys[:whole], fps[:whole], distance)
            keys, fps = keys[whole:], fps[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return (keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
            .mapInArrow(each, "u long, v long"))


def _midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links among the fingerprints of buckets too large to compare, exact and linear in their number.

    Two fingerprints differ in at most `distance` bits if and only if one of their balls of radius distance // 2 and
    (distance + 1) // 2 share a point; all that share a point are linked to the least whose smaller ball holds it.
    """
    lo, hi = distance // 2, (distance + 1) // 2
    flips = [0] + [sum(1 << b for b in bits) for n in range(1, hi + 1) for bits in itertools.combinations(range(64), n)]
    inner = sum(1 for f in flips if f.bit_count() <= lo)
    assert all(f.bit_count() <= lo for f in flips[:inner])
    masks = np.array(flips, np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                points = masks ^ fp
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points.view(np.int64)), pa.array(np.full(len(points), fp).view(np.int64)),
                     pa.array(np.arange(len(points)) < inner)], ["point", "fp", "inner"])

    points = fps.mapInArrow(each, "point long, fp long, inner boolean")
    least = points.filter("inner").groupBy("point").agg(F.min("fp").alias("u"))
    return points.join(least, "point").select("u", F.col("fp").alias("v")).filter("u != v")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) links among different fingerprints (fp, one row each); their components are those of all close pairs."""
    masks = block_masks(fps.count(), distance)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")))
                     for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "block-sizes")
    found = _bucket_links(keyed.join(sizes.filter(F.col("n") <= BUCKET), "key"), distance)
    large = sizes.filter(F.col("n") > BUCKET)
    if large.isEmpty():
        return found
    return found.unionByName(_midpoint_links(keyed.join(F.broadcast(large), "key").select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, fp (signed long), component_id, the least doc_id it is linked with.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay, each with its row; a
    null doc_id stays null and is never a component_id unless a component has no other. Other columns are ignored; an
    empty table gives no rows. Copies share a fingerprint and are linked as one, so their number costs nothing.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")),
                         "fingerprint-groups")
    member = components(links(groups.select("fp"), distance), "fingerprint-links")
    joined = groups.join(member, F.col("fp") == F.col("node"), "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    best = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = materialize(joined.join(best, "component").select("fp", "n", "component_id"), "fingerprint-components")
    return join_groups(prints, placed, "fp", "n", prints.count())


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` with all their columns, one of each component of `near_duplicates`.

    That with the least doc_id stays, null ids after all others; of rows repeated with one doc_id exactly one. Null and empty texts
    are near duplicates of each other. Columns may have any names; an empty table gives no rows.
    """
    row = fresh_name(docs.columns, "_row")
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    found = near_duplicates(stored.select(name.alias("doc_id"), "text"), shingle, distance)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.row").alias(row))
    return stored.join(kept, row, "left_semi").drop(row)
