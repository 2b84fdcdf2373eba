"""Cross-sectional features: targets, missing-value fill, ranks, interactions, dummies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.constants import MACROS, VALUES_PER_TASK
from panelloom.operators.joins import join_small
from panelloom.operators.orderstats import (average_ranks, fill_and_rank, fill_and_rank_in_blocks, fill_and_rank_in_ranges,
                                            group_medians, group_quantiles, part_large_groups, quoted)
from panelloom.operators.timeseries import attach_next_period
from panelloom.sources.storage import materialize

KEY = ["permno", "month_id"]
GROUP = ["month_id"]


# -- targets -------------------------------------------------------------------------------

def same_month_target(panel: DataFrame) -> DataFrame:
    """Own return as the target; size is last period's, known before the return."""
    return panel.select(
        "*",
        F.col("ret_excess").alias("y"),
        F.col("month").alias("target_month"),
        F.col("month_id").alias("target_month_id"),
        F.year("month").cast("bigint").alias("target_year"),
        F.col("mktcap_lag").alias("size_for_ranking"))


def next_month_target(panel: DataFrame) -> DataFrame:
    """Return of the next calendar month as the target; size is this month's."""
    ahead = attach_next_period(panel, {"y": "ret_excess", "target_month": "month"})
    return ahead.select("*", F.year("target_month").cast("bigint").alias("target_year"),
                        F.col("mktcap").alias("size_for_ranking"))


def attach_target(panel: DataFrame, mode: str) -> DataFrame:
    if mode == "same_month":
        return same_month_target(panel)
    if mode == "next_month":
        return next_month_target(panel)
    raise ValueError("mode must be 'same_month' or 'next_month'")


def target_sample(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows whose target exists and falls within the sample."""
    return df.filter(F.col("target_month_id").between(first, last) & F.col("y").isNotNull())


# -- fill and ranks ------------------------------------------------------------------------

def fill_with_median(df: DataFrame, columns: list[str], group: list[str] = GROUP,
                     precision: str = "double", values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Add `<c>_filled`: the value, else its group median, else zero; also the group size `_n_month`."""
    medians = group_medians(df, group, columns, "_median_", values_per_task)
    medians = materialize(medians.withColumnRenamed("group_rows", "_n_month"), "medians")
    return join_small(df, medians, group, "left").selectExpr(
        *map(quoted, df.columns), "_n_month",
        *[f"CAST(coalesce(CAST({quoted(c)} AS DOUBLE), {quoted('_median_' + c)}, 0D) AS {precision}) "
          f"AS {quoted(c + '_filled')}" for c in columns])


def rank_transform(df: DataFrame, columns: list[str], key: list[str] = KEY, group: list[str] = GROUP,
                   precision: str = "double", values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Add `<c>_rank` from `<c>_filled` and `_n_month` (see `fill_with_median`).

    Ranks 1..n are spread over [-1, 1]; the only row of a group sits at 0.
    """
    filled = [c + "_filled" for c in columns]
    ranked = average_ranks(df, key, group, filled, "_avg_rank", values_per_task)
    return ranked.selectExpr(
        *map(quoted, df.columns),
        *[f"CAST(if(_n_month > 1, 2D * ({quoted(f + '_avg_rank')} - 1D) / (_n_month - 1D) - 1D, 0D) AS {precision}) "
          f"AS {quoted(c + '_rank')}" for c, f in zip(columns, filled)])


def ranked_features(df: DataFrame, columns: list[str], key: list[str] = KEY, group: list[str] = GROUP,
                    precision: str = "double", values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """`fill_with_median` and `rank_transform` in one: the other columns of `df` and `<c>_rank`.

    Months that fit a task take one shuffle; of larger ones a task takes a block of columns; a column too long
    for that is cut into ranges. The result is the same. `df` is read for the sizes and then for the work: pass a stored table.
    """
    small, large = part_large_groups(df, group, values_per_task // len(columns))
    made = fill_and_rank(small, group, columns, precision)
    if large is None:
        return made
    middle, large = part_large_groups(large, group, values_per_task)
    made = made.unionByName(fill_and_rank_in_blocks(middle, key, group, columns, precision, values_per_task))
    if large is None:
        return made
    return made.unionByName(fill_and_rank_in_ranges(large, key, group, columns, precision, values_per_task))


# -- macro states --------------------------------------------------------------------------

def fill_macros_global(df: DataFrame, macros: dict[str, str], precision: str = "float",
                       values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """`macro_<name>` filled with the median over all rows, later ones included.

    Reproduces published results; for forecasting use `fill_macros_expanding`.
    """
    columns = list(macros.values())
    found = group_quantiles(df, [], columns, [0.5], "linear", values_per_task).collect()
    median = {columns[r["feature"]]: r["q"][0] for r in found}
    return _macro_columns(df, macros, precision, lambda c: F.lit(median.get(c)).cast("double"))


def fill_macros_expanding(df: DataFrame, macros: dict[str, str], time: str = "month_id",
                          precision: str = "float") -> DataFrame:
    """`macro_<name>` filled with the median of the series up to the same month.

    A macro series has one value per month, so the running median is taken over one row per month
    (as many as the calendar has) and joined back.
    """
    columns = list(macros.values())
    monthly = df.groupBy(time).agg(*[F.max(c).alias(c) for c in columns])
    so_far = W.orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = monthly.select(time, *[
        F.percentile(F.col(c).cast("double"), F.lit(0.5)).over(so_far).alias("_running_" + c)
        for c in columns])
    joined = join_small(df, materialize(running, "running-medians"), [time], "left")
    filled = _macro_columns(joined, macros, precision, lambda c: F.col("_running_" + c))
    return filled.drop(*["_running_" + c for c in columns])


def _macro_columns(df: DataFrame, macros: dict[str, str], precision: str, fallback) -> DataFrame:
    made = {f"macro_{name}": F.coalesce(F.col(c).cast("double"), fallback(c), F.lit(0.0)).cast(precision)
            for name, c in macros.items()}
    kept = [c for c in df.columns if c not in made]
    return df.select(*kept, *[expr.alias(name) for name, expr in made.items()])


def interaction_names(columns: list[str], macros: list[str] = MACROS) -> list[str]:
    """Feature names, each rank followed by its products with the macro states."""
    return [name for c in columns for name in [f"{c}_rank"] + [f"{c}_x_{m}" for m in macros]]


def add_interactions(df: DataFrame, columns: list[str], macros: list[str] = MACROS,
                     precision: str = "float") -> DataFrame:
    """Add `<c>_x_<m>` for every rank and macro state: columns x (1 + macros) features in all."""
    return df.selectExpr("*", *[
        f"CAST({quoted(c + '_rank')} * {quoted('macro_' + m)} AS {precision}) AS {quoted(f'{c}_x_{m}')}"
        for c in columns for m in macros])


def industry_codes(df: DataFrame, column: str = "sic2", max_codes: int = 100) -> list[int]:
    """Distinct two-digit codes in order; more than `max_codes` means the column holds something else."""
    codes = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct()
                                .limit(max_codes + 1).collect()]
    if len(codes) > max_codes:
        raise ValueError(f"{column} has more than {max_codes} distinct values")
    return sorted(codes)


def add_industry_dummies(df: DataFrame, codes: list[int], column: str = "sic2",
                         prefix: str = "sic_") -> DataFrame:
    """One 0/1 column per code; all zero for a row without a code."""
    return df.select("*", *[
        F.when(F.col(column) == k, 1.0).otherwise(0.0).alias(f"{prefix}{k}") for k in codes])
