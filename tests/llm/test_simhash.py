"""SimHash links against all pairs of a small corpus."""

import random

import numpy as np
import pytest
import xxhash

from panelloom.llm import simhash
from panelloom.llm.components import components


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i: i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=4):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)), key=lambda k: ids[k])
                parent[b] = a
    return [ids[top(i)] for i in range(len(ids))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)] + ["É", "ß", "naïve", "A-B"]
    texts = [None, "", " \t", "One", "one", "one two three", "ONE two\x0bthree four five", "x\x1cy z é w v"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = base[:]
            near[rng.randrange(len(near))] = "changed"
            texts.append("  ".join(near))
    texts += texts[20:24]
    return texts


def test_components_equal_all_pairs(spark, corpus):
    ids = list(range(len(corpus)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, corpus)], "doc_id long, text string, fp int")
    fps = [plain_fingerprint(t) for t in corpus]
    want = {i: (f, c) for i, f, c in zip(ids, fps, plain_components(ids, fps))}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"])
           for r in simhash.near_duplicates(docs.repartition(3)).collect()}
    assert got == want
    assert len(set(c for _, c in got.values())) < len(set(f for f, _ in got.values()))


@pytest.mark.parametrize("distance", [3, 4])
def test_midpoints_and_big_buckets_link_the_same(spark, monkeypatch, distance):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {0, (1 << 64) - 1}
    for _ in range(150):
        bits = rng.choice(64, rng.integers(0, 7), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    want = plain_components(fps, fps, distance)
    for bucket in (8, 1 << 16):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {r["node"] & (1 << 64) - 1: r["component"] for r in
                 components(simhash.links(frame, distance)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(found.get(f, ("alone", f)), set()).add(f)
        plain = {}
        for f, c in zip(fps, want):
            plain.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_block_choices_cover_every_close_pair():
    rng = np.random.default_rng(0)
    for count in (10, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(count, 4)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & m == 0 for m in masks)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "same text"), (5, "same text"), (None, "alone")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect() if
                 r["component_id"])
    assert got == [(-1, 5), (5, 5)]
