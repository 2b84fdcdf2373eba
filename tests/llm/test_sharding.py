"""Longest-processing-time dealing against one heap over all groups."""

import heapq
import zlib

import numpy as np
import pytest

from panelloom.llm import sharding


def plain(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("seed", range(20))
def test_level_deals_as_a_heap(seed):
    rng = np.random.default_rng(seed)
    loads = rng.integers(0, 2000, 8).tolist()
    size, count = int(rng.integers(1, 90)), int(rng.integers(0, 900))
    given = sharding.level(loads, size, count)
    heap = loads[:]
    heapq.heapify(heap)
    for _ in range(count):
        heapq.heappush(heap, heapq.heappop(heap) + size)
    assert sum(given) == count
    assert sorted(n + size * g for n, g in zip(loads, given)) == sorted(heap)


@pytest.mark.parametrize("alone", [4, 1 << 13])
def test_shards_of_a_corpus(spark, monkeypatch, alone):
    monkeypatch.setattr(sharding, "ALONE", alone)
    rng = np.random.default_rng(5)
    texts = ["é" * int(n) for n in rng.integers(0, 900, 300)] + [None, "", None] + ["copy " * 30] * 150
    rows = [(None if i == 7 else i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.shard_by_bytes(docs, 8).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    groups = {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        groups.setdefault(raw, []).append(by_id[i]["shard"])
    assert all(len(set(s)) == 1 for s in groups.values())
    loads = np.zeros(8, int)
    for s in range(8):
        own = [r for r in got if r["shard"] == s]
        loads[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    whole = plain([(len(t) + 1) * len(s) for t, s in groups.items()], 8)
    assert sorted(loads.tolist()) == whole  # classes are exact at these sizes


def test_large_sizes_share_classes(spark):
    found = [r[0] for r in spark.range(1).selectExpr("explode(array(1L, 2047L, 2048L, 2049L, 1234567L)) AS _size")
             .select(sharding.size_class(sharding.F.col("_size"))).collect()]
    assert found == [1, 2047, 2048, 2048, 1234567 >> 10 << 10]


def test_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
