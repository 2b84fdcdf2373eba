"""Connected components of a link table, by alternating large-star and small-star rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.sources.storage import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half round. Each node u finds the least node m among itself and its neighbours and links them to m.

    Large star: neighbours above u; small star: u itself and neighbours below it. Both keep connectivity.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("_least")).select("u", F.least("u", "_least").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (u, v: comparable, not null); component is its least node.

    Every round is written to the shared folder, so lost executors cost one round. The rounds grow with the logarithm
    of a component's size; the driver sees only a count and a checksum.
    """
    now = materialize(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), label)
    seen = None
    while True:
        now = materialize(_stars(_stars(now, True), False), label)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
