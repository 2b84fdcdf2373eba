"""Joins against small series, with a checked broadcast and a salted way beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.constants import BROADCAST_CELLS


def fits_broadcast(df: DataFrame, max_cells: int = BROADCAST_CELLS, cells_per_row: int | None = None) -> bool:
    """Whether rows x cells per row stays within `max_cells`; counts no further than that.

    A column is one cell unless `cells_per_row` says otherwise (arrays).
    """
    max_rows = max_cells // (cells_per_row or len(df.columns))
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
               max_cells: int = BROADCAST_CELLS, cells_per_row: int | None = None, salts: int | None = None) -> DataFrame:
    """Join the rows of `left` to a right side that should be small.

    Within `max_cells` the right side is broadcast and `left` does not move. A larger one is
    repeated `salts` times and joined on (key, salt), so that a key holding a large share of
    `left` is spread over `salts` tasks: an eighth of the session's shuffle partitions unless given, 32 at least.
    Both give the same rows. The right side is counted first,
    so store it if it is costly to compute.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if fits_broadcast(right, max_cells, cells_per_row):
        return left.join(F.broadcast(right), on, how)
    salts = salts or max(32, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    spread = [F.col(c) for c in left.columns]
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, on + ["_salt"], how).drop("_salt")
