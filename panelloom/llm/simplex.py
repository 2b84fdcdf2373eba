"""Centroid clustering in whole numbers, with n-simplex projection to leave out centroids that can't be nearest.

A few pivots span a base simplex. A vector's distances to them, computed once and stored, place it as the apex over that base: its
coordinates within the pivots' space and its height above it. Of two apexes the Euclidean distance bounds the vectors'
distance from below, and the same with one of the heights turned over from above. A centroid whose lower bound is above the least upper
bound isn't compared; all others are, by exact squared distances of whole numbers, so rounding never decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import ship
from panelloom.sources.storage import materialize

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
#: Components become floor(SCALE * x).
SCALE = 256
#: Largest magnitude of such a component: squared distances of 64 of them fit a long.
LARGEST = 1 << 27
PIVOTS = 16
#: A pivot stands out of the others' space by at least this share of the widest distance, squared.
_LEAST_HEIGHT = 1e-3
#: Bounds are widened by this share of the squared lengths they come from: far above the rounding of doubles.
_SLACK = 1e-6
#: Pairs compared exactly at a time.
_PAIRS = 1 << 15


def whole_numbers(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): vectors of `components` finite numbers, as floor(256 * x). Others are left out."""
    top = LARGEST / SCALE
    usable = (F.size("embedding") == components) & F.forall("embedding", lambda x: F.abs(x.cast("double")) < top)  # false for NaN
    return vectors.filter(usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))


class Simplex:
    """Pivots among `points` (whole numbers, a row each), chosen so that each stands well out of the others' space."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        chosen, rest = [0], (points - points[0]).astype(float)
        widest = (rest ** 2).sum(1).max(initial=0.0)
        while len(chosen) < min(most, len(points)):
            height = (rest ** 2).sum(1)
            far = int(height.argmax())
            if height[far] <= _LEAST_HEIGHT * widest:
                break
            chosen.append(far)
            axis = rest[far] / np.sqrt(height[far])
            rest = rest - np.outer(rest @ axis, axis)
        self.pivots = points[chosen].astype(np.int64)
        base = (self.pivots[1:] - self.pivots[0]).astype(float)
        gram = base @ base.T
        self.square = np.diag(gram).copy()
        self.turn = np.linalg.inv(np.linalg.cholesky(gram)) if len(base) else np.zeros((0, 0))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates of each vector's apex, the height last, from its squared distances to the pivots alone."""
        distance = np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], axis=1).astype(float)
        flat = ((distance[:, :1] + self.square - distance[:, 1:]) / 2) @ self.turn.T
        height = np.sqrt(np.maximum(distance[:, 0] - (flat ** 2).sum(1), 0))
        return np.column_stack([flat, height])


def candidates(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each vector (row) the centroids (column) that may be nearest, by the bounds between their apexes."""
    own, other = (apexes ** 2).sum(1)[:, None], (centroids ** 2).sum(1)
    slack = _SLACK * (own + other) + 1
    lower = own + other - 2 * apexes @ centroids.T
    upper = lower + 4 * np.outer(apexes[:, -1], centroids[:, -1])
    return lower - slack <= (upper + slack).min(axis=1, keepdims=True)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equals the smaller number."""
    row, column = np.nonzero(candidates(apexes, centroid_apexes))
    distance = np.full((len(vectors), len(centroids)), np.iinfo(np.int64).max)
    for k in range(0, len(row), _PAIRS):
        r, c = row[k: k + _PAIRS], column[k: k + _PAIRS]
        gap = vectors[r] - centroids[c]
        distance[r, c] = np.einsum("ij,ij->i", gap, gap)
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(vectors)), cluster]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cached(whole: DataFrame, simplex: Simplex, components: int) -> DataFrame:
    """(vec_id, v, apex), stored: the distances to the pivots are computed once for all rounds."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_matrix(batch.column(1), components).astype(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, apexes.size + 1, apexes.shape[1], np.int32), apexes.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "apex"])

    schema = T.StructType([*whole.schema.fields, T.StructField("apex", T.ArrayType(T.DoubleType()))])
    return materialize(whole.mapInArrow(each, schema), "apexes")


def _assigner(simplex: Simplex, centroids: np.ndarray, components: int):
    placed = simplex.apexes(centroids)

    def assign(batch: pa.RecordBatch):
        vectors = _matrix(batch.column(1), components).astype(np.int64)
        return vectors, *nearest(vectors, _matrix(batch.column(2), placed.shape[1]), centroids, placed)

    return assign


def _moved(cached: DataFrame, simplex: Simplex, centroids: np.ndarray, components: int) -> np.ndarray:
    """The centroids after a round: exact floors of their vectors' means. Tasks return a line of sums for each centroid."""
    assign = _assigner(simplex, centroids, components)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), components), np.int64)
        for batch in batches:
            vectors, cluster, _ = assign(batch)
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, vectors)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(np.arange(0, used.size * components + 1, components, np.int32), total[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["cluster", "n", "total"])

    sums = cached.mapInArrow(each, "cluster long, n long, total array<long>")
    sums = sums.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    moved = centroids.copy()
    for r in sums.collect():
        moved[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
    return moved


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, prefix: str = "2:",
            pivots: int = PIVOTS) -> DataFrame:
    """One line per usable row of `vectors` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable are rows with exactly `components` numbers, none null, NaN or infinite, below 2^19 in magnitude (so that squared distances fit a
    long); all others are left out. The first centroids are the rows with the least SHA-256 of prefix and vec_id (null: nothing), equal ones
    by their numbers; with fewer usable rows than `centroids` there are fewer. In each round every row goes to the nearest centroid
    (ties: the smaller number), then every centroid that has rows becomes the floor of their mean. Repeated rows and ids count each;
    no usable row gives no rows; other columns are ignored whatever their names. Only centroids and their sums come to the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_numbers(vectors, components)
    digest = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(centroids).collect()
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not first:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    now = np.array([r["v"] for r in first], np.int64)
    simplex = Simplex(now, pivots)
    cached = _cached(whole, simplex, components)
    for _ in range(rounds):
        now = _moved(cached, simplex, now, components)
    assign = _assigner(simplex, now, components)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, number, distance = assign(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = materialize(cached.mapInArrow(each, schema), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    lines = [(k, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, now[k].tolist())).encode()).hexdigest()) for k, s in inertia.items()]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS) -> str:
    """The same by comparing every vector with every centroid."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {components}
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
            f"""q AS MATERIALIZED (SELECT r, j, CAST(floor({SCALE} * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x
        FROM kept CROSS JOIN (SELECT CAST(unnest(range(1, {components + 1})) AS BIGINT) AS j))""",
            f"""c0 AS MATERIALIZED (SELECT c, j, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept
        QUALIFY c < {centroids}) JOIN q USING (r))"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT q.r, c.c, sum((q.x - c.x) * (q.x - c.x)) AS d FROM q JOIN c{i} c USING (j) GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, c.j, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n + n) % n)) // n AS BIGINT) END AS x
        FROM c{i} c LEFT JOIN (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{i} JOIN q USING (r) GROUP BY 1, 2) USING (c, j))""")
    return "WITH " + ", ".join(ctes) + f"""
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (r)
        JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c) h ON h.c = a.c"""
