"""Operators along one entity's own history.

An entity has one row per period, so its history is bounded by the calendar; `duplicate_keys`
checks that, and `attach_next_period` fails on a repeated period instead of mixing its rows up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    sample = duplicate_keys(df, keys).limit(5).collect()
    if sample:
        raise ValueError(f"Keys {keys} are not unique, for example {[r.asDict() for r in sample]}")
    return df


def lag_by_row(value: str | Column, entity: str = "permno", time: str = "month_id") -> Column:
    """Value of the entity's previous row, however many periods ago that row is."""
    value = F.col(value) if isinstance(value, str) else value
    return F.lag(value, 1).over(W.partitionBy(entity).orderBy(time))


def attach_next_period(df: DataFrame, columns: dict[str, str], entity: str = "permno",
                       time: str = "month_id", next_time: str = "target_month_id") -> DataFrame:
    """Add `columns` (new name -> source) of the entity's row exactly one period later.

    The calendar-shifted self-join is expressed as a look-ahead: the next row counts only when
    its period is `time + 1`. One shuffle on the entity replaces two on (entity, period), and the
    wide rows are not shuffled twice. Rows without a successor get NULLs.
    """
    ahead = W.partitionBy(entity).orderBy(time)
    following = F.lead(F.col(time), 1).over(ahead)
    is_next = F.col("_following") == F.col(time) + 1
    repeated = F.raise_error(F.concat(
        F.lit(f"repeated ({entity}, {time}): "), F.col(entity).cast("string"), F.lit(", "),
        F.col(time).cast("string")))
    looked = df.select(
        "*", following.alias("_following"),
        *[F.lead(F.col(src), 1).over(ahead).alias(f"_next_{new}") for new, src in columns.items()])
    return looked.select(
        *df.columns,
        F.when(F.col("_following") == F.col(time), repeated.cast("bigint"))
         .when(is_next, F.col("_following")).alias(next_time),
        *[F.when(is_next, F.col(f"_next_{new}")).alias(new) for new in columns])
