"""Clustering against plain comparisons of every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from panelloom.llm import simplex

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, v int"


def plain(rows, centroids, rounds, components):
    kept = [(i, [math.floor(256 * float(x)) for x in np.float32(v)]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:centroids]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(place(v)[1], []).append(v)
        now = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(now)]
    out = [(i, *place(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    own = {}
    for _, d, k in out:
        own[k] = own.get(k, 0) + d
    return [(i, k, d, own[k], total, hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()) for i, d, k in out]


def rows_of(rng, n, components, spread):
    middle = rng.normal(size=(8, components)) * 2
    points = middle[rng.integers(8, size=n)] + rng.normal(size=(n, components)) * spread
    return [(i, points[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("centroids, rounds, components, spread", [(7, 4, 6, 0.3), (40, 5, 64, 1.0), (12, 2, 3, 0.0), (5, 0, 4, 0.5)])
def test_equals_plain_clustering(spark, centroids, rounds, components, spread):
    rng = np.random.default_rng(components)
    rows = rows_of(rng, 150, components, spread)
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], rows[5][1]), (None, rows[6][1])]  # repeated rows and ids
    rows += [(900, None), (901, []), (902, [1.0] * (components + 1)), (903, [float("nan")] * components), (904, [float("inf")] + [0.0] * (components - 1)),
             (905, [None] + [0.0] * (components - 1)), (906, [-500_000.0] * components), (907, [-0.001] * components)]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    found = simplex.cluster(frame, centroids, rounds, components)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain(rows, centroids, rounds, components), key=repr)


def test_equal_vectors_fewer_rows_than_centroids_and_none(spark):
    rows = [(i, [0.5, -0.25]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert {r["cluster"] for r in simplex.cluster(frame, 9, 2, 2).collect()} == {0}
    for none in (frame.limit(0), frame.selectExpr("vec_id", "cast(null AS array<double>) AS embedding")):
        got = simplex.cluster(none, 9, 2, 2)
        assert got.count() == 0 and got.dtypes[3:] == [("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


def test_bounds_hold_and_leave_most_centroids_out():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 64)) * 500
    points = np.floor(middle[rng.integers(40, size=2000)] + rng.normal(size=(2000, 64)) * 100).astype(np.int64)
    centroids = np.floor(middle).astype(np.int64)
    base = simplex.Simplex(centroids)
    assert len(base.pivots) == simplex.PIVOTS
    a, c = base.apexes(points), base.apexes(centroids)
    exact = ((points[:, None] - centroids) ** 2).sum(2)
    lower = ((a[:, None] - c) ** 2).sum(2)
    upper = ((a[:, None] - c * np.r_[np.ones(15), -1]) ** 2).sum(2)
    assert (lower <= exact * (1 + 1e-9) + 1).all() and (upper >= exact * (1 - 1e-9) - 1).all()
    maybe = simplex.candidates(a, c)
    assert maybe[np.arange(2000), exact.argmin(1)].all() and maybe.mean() < 0.5
    number, distance = simplex.nearest(points, a, centroids, c)
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_largest_numbers_do_not_overflow():
    top = simplex.LARGEST
    points = np.array([[top] * 64, [-top] * 64, [0] * 64])
    base = simplex.Simplex(points)
    number, distance = simplex.nearest(points, base.apexes(points), points[:2], base.apexes(points[:2]))
    assert number.tolist() == [0, 1, 0] and distance.tolist() == [0, 0, 64 * top * top]


def test_pivots_in_one_line():
    points = np.array([[0, 0], [5, 5], [9, 9], [9, 9]])
    assert len(simplex.Simplex(points).pivots) == 2
    assert len(simplex.Simplex(points[:1]).pivots) == 1
