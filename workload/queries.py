"""Registered queries: (spark, sf_dir) -> DataFrame, each over the whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.constants import LINEAR_CHARACTERISTICS, MACROS
from panelloom.functions import cleaning as clean
from panelloom.functions import finance
from panelloom.operators import evaluate as ev
from panelloom.operators import features as ft
from panelloom.operators import regression as rg
from panelloom.operators.orderstats import average_ranks
from panelloom.operators.timeseries import duplicate_keys
from panelloom.operators.trees import BoostSettings, ForestSettings, fit_boosted_windows, model_table, predict_boosted, predict_forest
from panelloom.plans import walkforward as wf
from panelloom.plans.panel import clean_macro, clean_risk_free, clean_securities
from panelloom.plans.prepare import prepare_panel, target_panel
from panelloom.sources.schema import resolve_macro_columns
from panelloom.sources.storage import materialize, scratch_path
from panelloom.sources.tables import (csv_to_parquet, read_csv_clean, read_parquet, write_by_year, write_parquet,
                                      write_summary_csv)
from workload import tables as tb

TEST_YEARS = range(1998, 2002)
GAP = 2
WINDOWS = wf.walk_forward_windows(TEST_YEARS, GAP)
K = 20
LINEAR = LINEAR_CHARACTERISTICS
LINEAR_RANKS = [f"{c}_rank" for c in LINEAR]
HUBER_SHARE = 0.99
# conditional sums that make a wide panel out of the lines
WIDE = [(line, flag, measure) for line in range(1, 8) for flag in "ANR"
        for measure in ("qty", "price", "discount", "tax")]
WIDE_NAMES = [f"{m}_{line}{flag.lower()}" for line, flag, m in WIDE]


def rounded(value: str | Column, digits: int = 9) -> Column:
    """Rounded, without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def _round_all(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}`, {digits}) + 0D AS `{c}`" if c in names else f"`{c}`" for c in df.columns])


def _round_many(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    """`_round_all` for many double columns, in numpy: the same decimal rounding, halves away from zero, without a decimal object for each value."""
    scale, step, wide = 10.0 ** digits, Decimal(1).scaleb(-digits), Context(prec=400)

    def exact(value: float) -> float:
        return float(Decimal(repr(value)).quantize(step, ROUND_HALF_UP, wide)) if np.isfinite(value) else value

    def nearest(column: pa.Array) -> pa.Array:
        value = column.fill_null(0.0).to_numpy()
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.abs(value) * scale
            found = np.copysign(np.floor(scaled + 0.5) / scale, value)
            # too near to a half for what the product loses
            open_ = np.flatnonzero(~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-15 * scaled))
        if len(open_):
            distinct, place = np.unique(value[open_], return_inverse=True)
            found[open_] = np.array([exact(v) for v in distinct.tolist()])[place]
        return pa.array(found + 0.0, mask=~column.is_valid().to_numpy(zero_copy_only=False))

    def round_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([nearest(batch.column(c)) if c in names else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(round_all, df.schema)


# -- sources and scalar functions ----------------------------------------------------------

def _coded_text() -> Column:
    """Line values as text with codes by line number: 1 to 7 are all present."""
    number, line = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber")
    return (F.when(line == 1, F.concat(F.lit(" "), number, F.lit("  ")))
             .when(line == 2, F.concat(number, F.lit(".5")))
             .when(line == 3, F.concat(number, F.lit("d")))
             .when(line == 4, F.when(F.col("l_quantity") < 25, "null").otherwise("."))
             .when(line == 5, F.concat(number, F.lit(".0")))
             .when(line == 6, F.when(F.col("l_quantity") < 25, "NaN").otherwise("Z"))
             .otherwise(F.concat(F.lit("-"), number, F.lit("e1"))))


def null_tokens_trim(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    return (lines.select("l_linenumber", clean.blank_tokens(_coded_text()).alias("text"))
                 .groupBy("l_linenumber", "text").agg(F.count(F.lit(1)).alias("n")))


def lenient_cast(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").select("l_linenumber", _coded_text().alias("text"))
    return (lines.select("l_linenumber", clean.lenient_double(F.col("text")).alias("as_double"),
                         clean.lenient_long(F.col("text")).alias("as_long"))
                 .groupBy("l_linenumber", "as_double", "as_long").agg(F.count(F.lit(1)).alias("n")))


def strict_cast(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 1, " NA ").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    return (lines.select(clean.strict_long(text).alias("as_long"), clean.strict_double(text).alias("as_double"))
                 .groupBy("as_long", "as_double").agg(F.count(F.lit(1)).alias("n")))


def parse_dates(spark, sf_dir):
    day = F.col("l_shipdate")
    lines = tb.table(spark, sf_dir, "lineitem").select(
        (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).alias("compact"),
        F.concat_ws("/", F.day(day), F.month(day), F.year(day)).alias("slashes"))
    return (lines.select(clean.date_from_compact(F.col("compact")).alias("day"),
                         clean.date_from_slashes(F.col("slashes")).alias("same_day"))
                 .groupBy("day", "same_day").agg(F.count(F.lit(1)).alias("n")))


def month_index(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    return lines.groupBy(clean.month_index(F.col("l_shipdate")).alias("month_id")).agg(
        F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"),
        F.count(F.lit(1)).alias("n"))


def yyyymm_split(spark, sf_dir):
    day = F.col("o_orderdate")
    orders = tb.table(spark, sf_dir, "orders").select((F.year(day) * 100 + F.month(day)).alias("yyyymm"))
    return (orders.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("yyyymm").cast("bigint").alias("yyyymm"), "n",
                          clean.month_index_from_yyyymm(F.col("yyyymm")).alias("month_id")))


def csv_parquet_roundtrip(spark, sf_dir):
    """Strings to CSV, CSV to typed parquet once."""
    folder = scratch_path(spark, "csv")
    raw = tb.raw_securities(tb.cells(spark, sf_dir))
    raw.write.option("header", True).csv(f"{folder}/wrds.csv")
    for _ in range(2):  # the second call finds the output and leaves it alone
        stored = csv_to_parquet(spark, {"wrds": f"{folder}/wrds.csv"}, folder, {"wrds": clean_securities})
    return read_parquet(spark, stored["wrds"])


def prediction_store(spark, sf_dir):
    """Forecasts by target year, one year written again, read back."""
    path = scratch_path(spark, "predictions")
    preds = materialize(_trivial_forecast(spark, sf_dir), "forecast")
    write_by_year(preds, path)
    write_by_year(preds.filter(F.col("target_year") == 1999), path)
    return _round_all(read_parquet(spark, path).select(
        "permno", "month_id", F.col("target_year").cast("bigint").alias("target_year"), "prediction"), ["prediction"])


def prediction_concat(spark, sf_dir):
    """Yearly forecasts put together in one parquet table."""
    preds = materialize(_trivial_forecast(spark, sf_dir), "forecast")
    years = [wf.split(preds, test_year=r[0]) for r in preds.select("target_year").distinct().orderBy("target_year").collect()]
    whole = years[0]
    for part in years[1:]:
        whole = whole.unionByName(part)
    path = write_parquet(whole, scratch_path(spark, "all-years"))
    return read_parquet(spark, path).groupBy("target_year").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("prediction"), 6).alias("total"))


def summary_csv(spark, sf_dir):
    path = scratch_path(spark, "summary")
    write_summary_csv(oos_r2_summary(spark, sf_dir), path)
    back = read_csv_clean(spark, path)
    numbers = ["r2_all_pct", f"r2_top{K}_pct", f"r2_bottom{K}_pct"]
    return back.select("model", "target_mode", *[rounded(clean.strict_double(F.col(c)), 6).alias(c) for c in numbers],
                       clean.strict_long(F.col("n_obs")).alias("n_obs"),
                       clean.strict_long(F.col("n_features")).alias("n_features"))


# -- panel ---------------------------------------------------------------------------------

def delist_adjusted_return(spark, sf_dir):
    return tb.securities(spark, sf_dir).select("permno", "month_id", "ret", "dlret", "ret_adj")


def market_cap(spark, sf_dir):
    return tb.securities(spark, sf_dir).select("permno", "month_id", "price_abs", "mktcap")


def security_codes(spark, sf_dir):
    return tb.securities(spark, sf_dir).groupBy("shrcd", "exchcd", "siccd_crsp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vol").alias("vol"))


def lag_by_row(spark, sf_dir):
    return tb.securities(spark, sf_dir).select("permno", "month_id", "mktcap", "mktcap_lag")


def risk_free(spark, sf_dir):
    return clean_risk_free(tb.raw_risk_free(tb.order_months(spark, sf_dir)))


def macro_predictors(spark, sf_dir):
    macro = clean_macro(tb.raw_macro(tb.order_months(spark, sf_dir)))
    return _round_all(macro, [f"macro_{m}" for m in MACROS])


def master_panel(spark, sf_dir):
    return _round_all(tb.panel(spark, sf_dir), ["macro_dp", "macro_ep"])


def excess_return(spark, sf_dir):
    return tb.panel(spark, sf_dir).select("permno", "month_id", "ret_adj", "rf", "ret_excess")


def macro_resolution(spark, sf_dir):
    panel = tb.panel(spark, sf_dir)
    found = resolve_macro_columns(panel.columns)
    return panel.groupBy("month_id").agg(*[rounded(F.max(c)).alias(m) for m, c in found.items()])


def key_uniqueness(spark, sf_dir):
    return duplicate_keys(tb.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def panel_qa(spark, sf_dir):
    return ev.panel_qa(tb.panel(spark, sf_dir))


def panel_coverage(spark, sf_dir):
    return ev.panel_coverage(tb.panel(spark, sf_dir))


# -- targets and features ------------------------------------------------------------------

def _sample(spark, sf_dir, mode="next_month", macros=None, columns=tb.FEATURES, extra=()):
    panel = tb.panel(spark, sf_dir)
    found = resolve_macro_columns(panel.columns) if macros else None
    return materialize(target_panel(panel, columns, mode, tb.FIRST_TARGET, tb.LAST_TARGET, found, extra), "target")


TARGET_COLUMNS = ["permno", "month_id", "target_month", "target_month_id", "target_year", "y", "size_for_ranking"]


def next_month_target(spark, sf_dir):
    return _sample(spark, sf_dir).select(TARGET_COLUMNS)


def colocated_panel(spark, sf_dir):
    return _round_all(tb.colocated_panel(spark, sf_dir), ["macro_dp", "macro_ep"])


def colocated_target(spark, sf_dir):
    panel = tb.colocated_panel(spark, sf_dir)
    return target_panel(panel, tb.FEATURES, "next_month", tb.FIRST_TARGET, tb.LAST_TARGET).select(TARGET_COLUMNS)


def same_month_target(spark, sf_dir):
    return _sample(spark, sf_dir, "same_month").select(TARGET_COLUMNS)


def month_median_fill(spark, sf_dir):
    filled = ft.fill_with_median(_sample(spark, sf_dir), tb.FEATURES)
    names = [f"{c}_filled" for c in tb.FEATURES]
    return _round_all(filled.select("permno", "month_id", "_n_month", *names), names)


def _ranked(spark, sf_dir, precision="double", **size):
    return ft.ranked_features(_sample(spark, sf_dir), tb.FEATURES, precision=precision, **size)


def rank_transform(spark, sf_dir):
    names = [f"{c}_rank" for c in tb.FEATURES]
    return _round_all(_ranked(spark, sf_dir).select("permno", "month_id", *names), names)


def rank_transform_float(spark, sf_dir):
    """Narrowed before ranking, so values equal in single precision tie."""
    names = [f"{c}_rank" for c in tb.FEATURES]
    return _ranked(spark, sf_dir, "float").select(
        "permno", "month_id", *[rounded(F.col(c).cast("double")).alias(c) for c in names])


def _wide(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("permno"), clean.month_index(F.col("l_shipdate")).alias("month_id"),
        F.concat("l_linenumber", F.lower("l_returnflag")).alias("slot"),
        F.col("l_quantity").cast("bigint").alias("qty"), tb.hundredths(F.col("l_extendedprice")).alias("price"),
        tb.hundredths(F.col("l_discount")).alias("discount"), tb.hundredths(F.col("l_tax")).alias("tax"))
    return materialize(tb.sums_by_slot(lines, ["permno", "month_id"], "slot", list(zip(WIDE_NAMES, [(f"{line}{flag.lower()}", m) for line, flag, m in WIDE]))), "wide")


def wide_rank_transform(spark, sf_dir):
    """84 columns filled and ranked per month."""
    names = [f"{c}_rank" for c in WIDE_NAMES]
    return _round_many(ft.ranked_features(_wide(spark, sf_dir), WIDE_NAMES).select("permno", "month_id", *names), names)


def wide_rank_transform_split(spark, sf_dir):
    """The same with every month too large for one task: columns apart, some of them cut."""
    names = [f"{c}_rank" for c in WIDE_NAMES]
    return _round_many(ft.ranked_features(_wide(spark, sf_dir), WIDE_NAMES, values_per_task=60)
                         .select("permno", "month_id", *names), names)


def rank_transform_split(spark, sf_dir):
    """The same ranks with every month treated as too large for one task."""
    names = [f"{c}_rank" for c in tb.FEATURES]
    return _round_all(_ranked(spark, sf_dir, values_per_task=16).select("permno", "month_id", *names), names)


def _null_ranks(spark, sf_dir, values_per_task):
    """Ranks of unfilled values: a missing one has none and counts in nobody's."""
    sample = _sample(spark, sf_dir).select("permno", "month_id", *tb.FEATURES)
    ranked = average_ranks(sample, ft.KEY, ft.GROUP, tb.FEATURES, "_place", values_per_task)
    return ranked.select("permno", "month_id", *[f"{c}_place" for c in tb.FEATURES])


def ranks_with_nulls(spark, sf_dir):
    return _null_ranks(spark, sf_dir, 1_000_000)


def ranks_with_nulls_split(spark, sf_dir):
    """The same with every month too large for one task."""
    return _null_ranks(spark, sf_dir, 16)


def _macro_sample(spark, sf_dir):
    sample = _sample(spark, sf_dir, macros=True)
    return sample, resolve_macro_columns(sample.columns)


def macro_global_fill(spark, sf_dir):
    sample, found = _macro_sample(spark, sf_dir)
    names = [f"macro_{m}" for m in MACROS]
    return _round_all(ft.fill_macros_global(sample, found, "double").select("permno", "month_id", *names), names)


def macro_expanding_fill(spark, sf_dir):
    sample, found = _macro_sample(spark, sf_dir)
    names = [f"macro_{m}" for m in MACROS]
    return _round_all(ft.fill_macros_expanding(sample, found, precision="double")
                        .select("permno", "month_id", *names), names)


def macro_interactions(spark, sf_dir):
    sample, found = _macro_sample(spark, sf_dir)
    narrow = sample.select("permno", "month_id", *LINEAR, *found.values())
    ranked = ft.fill_macros_expanding(ft.ranked_features(narrow, LINEAR, precision="float"), found)
    crossed = ft.add_interactions(ranked, LINEAR)
    return crossed.select("permno", "month_id", *[
        rounded(F.col(c).cast("double"), 6).alias(c) for c in ft.interaction_names(LINEAR)])


def industry_dummies(spark, sf_dir):
    codes = ft.industry_codes(tb.table(spark, sf_dir, "nation"), "n_nationkey")
    return ft.add_industry_dummies(tb.panel(spark, sf_dir).select("permno", "month_id", "sic2"), codes)


# -- scoring -------------------------------------------------------------------------------

def _trivial_forecast(spark, sf_dir):
    """A fixed mix of two ranks as the forecast; enough to exercise the reports."""
    ranked = _ranked(spark, sf_dir)
    return ranked.select(
        "permno", "month", "target_month", "month_id", "target_month_id", "target_year", "y",
        F.when(F.col("permno") % 31 != 0, F.col("size_for_ranking")).alias("size_for_ranking"),
        (0.05 - 0.2 * F.col("bm_rank") + 0.3 * F.col("mom12m_rank")).alias("prediction"))


def _gappy_forecast(spark, sf_dir):
    """Forecasts of some entities missing, not a number or infinite."""
    permno = F.col("permno")
    broken = (F.when(permno % 29 == 0, F.lit(float("nan"))).when(permno % 37 == 0, F.lit(float("inf")))
               .when(permno % 41 != 0, F.col("prediction")))
    return materialize(_trivial_forecast(spark, sf_dir).withColumn("prediction", broken), "forecast")


def finite_pairs(spark, sf_dir):
    preds = _gappy_forecast(spark, sf_dir)
    usable = clean.is_finite(F.col("y")) & clean.is_finite(F.col("prediction"))
    return preds.groupBy("target_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("n_usable"))


def top_bottom_k(spark, sf_dir):
    preds = materialize(_trivial_forecast(spark, sf_dir), "forecast")
    ends = ev.largest_and_smallest(preds, K)
    return ends.select("segment", "target_month_id", F.col("size_rank").cast("bigint").alias("size_rank"),
                       "permno", "size_for_ranking")


def oos_r2_summary(spark, sf_dir):
    summary = ev.r2_summary(_gappy_forecast(spark, sf_dir), "ranks", "next_month", K, len(tb.FEATURES))
    return _round_all(summary.withColumn("n_features", F.col("n_features").cast("bigint")),
                      ["r2_all_pct", f"r2_top{K}_pct", f"r2_bottom{K}_pct"], 6)


def yearly_r2(spark, sf_dir):
    return _round_all(ev.yearly_r2(_gappy_forecast(spark, sf_dir)), ["r2_pct"], 6)


def yearly_diagnostics(spark, sf_dir):
    table = ev.yearly_diagnostics(_trivial_forecast(spark, sf_dir))
    return _round_all(table, [c for c in table.columns if c not in ("year", "n")], 6)


def forecast_quantiles(spark, sf_dir):
    table = ev.forecast_quantiles(materialize(_trivial_forecast(spark, sf_dir), "forecast"))
    return _round_all(table, table.columns)


def forecast_quantiles_split(spark, sf_dir):
    """The same with the whole sample treated as too large for one task."""
    table = ev.forecast_quantiles(materialize(_trivial_forecast(spark, sf_dir), "forecast"), values_per_task=500)
    return _round_all(table, table.columns)


def forecast_quantiles_disc(spark, sf_dir):
    table = ev.forecast_quantiles(materialize(_trivial_forecast(spark, sf_dir), "forecast"), method="disc")
    return _round_all(table, table.columns)


def forecast_quantiles_linear(spark, sf_dir):
    """Interpolated, with the whole sample treated as too large for one task."""
    table = ev.forecast_quantiles(materialize(_trivial_forecast(spark, sf_dir), "forecast"), method="linear",
                                  values_per_task=500)
    return _round_all(table, table.columns)


def drift_table(spark, sf_dir):
    table = ev.drift_table(_sample(spark, sf_dir), WINDOWS)
    return _round_all(table, ["train_y_mean", "train_y_std", "test_y_mean", "test_y_std"], 8)


def huber_loss_terms(spark, sf_dir):
    """Loss, half slope and weight of returns around zero at a threshold of 0.5."""
    xi, y = F.lit(0.5), F.col("y")
    return _sample(spark, sf_dir).groupBy("target_year").agg(
        rounded(F.sum(finance.huber_loss(y, xi)), 6).alias("loss"),
        rounded(F.sum(finance.huber_psi(y, xi)), 6).alias("psi"),
        rounded(F.sum(finance.huber_weight(y, xi)), 6).alias("weight"))


# -- models --------------------------------------------------------------------------------

def _linear_table(spark, sf_dir, columns=LINEAR):
    return prepare_panel(tb.panel(spark, sf_dir), columns, first=tb.FIRST_TARGET, last=tb.LAST_TARGET)


def expanding_window_ols(spark, sf_dir):
    table, features = _linear_table(spark, sf_dir)
    fits = rg.fit_least_squares(table, features, WINDOWS)
    return _round_all(rg.coefficients(spark, fits, features).drop("xi"), ["intercept", *features], 8)


def huber_thresholds(spark, sf_dir):
    table, features = _linear_table(spark, sf_dir)
    xi = rg.huber_thresholds(rg.usable_rows(table, features), WINDOWS)
    return _round_all(spark.createDataFrame(sorted(xi.items()), "test_year bigint, xi double"), ["xi"])


def huber_coefficients(spark, sf_dir):
    table, features = _linear_table(spark, sf_dir)
    fits = rg.fit_huber(table, features, WINDOWS, HUBER_SHARE)
    return _round_all(rg.coefficients(spark, fits, features), ["xi", "intercept", *features], 7)


def huber_walkforward(spark, sf_dir):
    table, features = _linear_table(spark, sf_dir)
    preds = wf.linear_walk_forward(table, features, WINDOWS, quantile=HUBER_SHARE)
    return preds.select("permno", "month_id", "target_month_id", "target_year", rounded("y", 7).alias("y"),
                        rounded("prediction", 7).alias("prediction"), "model", "train_end_year")


def huber_r2(spark, sf_dir):
    """Flagship: how much of next month's return the linear forecasts explain, by size."""
    table, features = _linear_table(spark, sf_dir)
    preds = materialize(wf.linear_walk_forward(table, features, WINDOWS, quantile=HUBER_SHARE), "linear")
    return _round_all(ev.r2_summary(preds, "OLS3_Huber", "next_month", K),
                      ["r2_all_pct", f"r2_top{K}_pct", f"r2_bottom{K}_pct"], 4)


def _tree_table(spark, sf_dir):
    return prepare_panel(tb.panel(spark, sf_dir), tb.CHARACTERISTICS, precision="float",
                         first=tb.FIRST_TARGET, last=tb.LAST_TARGET)


def _forest_table(spark, sf_dir):
    return prepare_panel(tb.panel(spark, sf_dir), tb.CHARACTERISTICS, macros=MACROS, precision="float",
                         first=tb.FIRST_TARGET, last=tb.LAST_TARGET, industry="sic2")


def _checked(preds):
    """Per test year: forecasts, last training year, and how many forecasts are finite."""
    return preds.groupBy("target_year").agg(
        F.count(F.lit(1)).alias("n"), F.max("train_end_year").cast("bigint").alias("train_end"),
        F.count_if(clean.is_finite(F.col("prediction"))).alias("n_finite"), F.count_distinct("permno").alias("n_entities"))


def gbt_walkforward(spark, sf_dir):
    """All windows with the model's own settings."""
    table, features = _tree_table(spark, sf_dir)
    return _checked(materialize(wf.boosted_walk_forward(table, features, WINDOWS), "boosted"))


def gbt_base_value(spark, sf_dir):
    """Where boosting starts, per window."""
    table, features = _tree_table(spark, sf_dir)
    fits = fit_boosted_windows(table, features, [e for _, e in WINDOWS], BoostSettings(trees=0), cuts=wf.rank_cuts(features, 32))
    bases = [(t, e, fit.base) for (t, e), fit in zip(WINDOWS, fits)]
    return _round_all(spark.createDataFrame(bases, "test_year bigint, train_end bigint, base double"), ["base"])


#: Few trees, whose every split and leaf SQL can find too; children need not be as heavy as in the published settings.
FEW_BOOSTED = BoostSettings(trees=6, rate=0.3, min_child_weight=60)
FEW_FOREST = ForestSettings(trees=8, node_share=0.5, min_child_weight=60)


def _model_lines(spark, models):
    lines = model_table(spark, models)
    return _round_all(lines.filter("tree >= 0").withColumn("value", F.coalesce("value", F.lit(0.0))), ["value"], 7)


def _row_forecasts(table, models, predict):
    preds = wf.forecasts(table, models, WINDOWS, predict, "few", "double")
    return preds.select("permno", "month_id", "target_year", "train_end_year", rounded("prediction", 7).alias("prediction"))


def gbt_trees(spark, sf_dir):
    """Every node of a few boosted trees in every window: splits of second order, rows and columns drawn."""
    table, features = _tree_table(spark, sf_dir)
    return _model_lines(spark, wf.boosted_models(table, features, WINDOWS, FEW_BOOSTED))


def gbt_forecasts(spark, sf_dir):
    table, features = _tree_table(spark, sf_dir)
    return _row_forecasts(table, wf.boosted_models(table, features, WINDOWS, FEW_BOOSTED), predict_boosted)


def forest_trees(spark, sf_dir):
    """Every node of a small forest in every window, each tree and node with columns of its own."""
    table, features = _tree_table(spark, sf_dir)
    return _model_lines(spark, wf.forest_models(table, features, WINDOWS, FEW_FOREST))


def forest_forecasts(spark, sf_dir):
    table, features = _tree_table(spark, sf_dir)
    return _row_forecasts(table, wf.forest_models(table, features, WINDOWS, FEW_FOREST), predict_forest)


def forest_walkforward(spark, sf_dir):
    """All windows with the model's own settings; leaves are shrunk means, so forecasts stay within the targets."""
    table, features = _forest_table(spark, sf_dir)
    preds = materialize(wf.forest_walk_forward(table, features, WINDOWS), "forest")
    seen = [wf.split(table, train_max_year=e).agg(F.lit(t).cast("bigint").alias("target_year"), F.min("y").alias("least"), F.max("y").alias("most"))
            for t, e in WINDOWS]
    ranges = seen[0]
    for r in seen[1:]:
        ranges = ranges.unionByName(r)
    inside = preds.join(ranges, "target_year").groupBy("target_year").agg(
        F.count_if(F.col("prediction").between(F.col("least") - 1e-6, F.col("most") + 1e-6)).alias("n_within"))
    return _checked(preds).join(inside, "target_year")


def forest_features(spark, sf_dir):
    """Ranks, interactions and industry dummies that the forest sees: the number of features, and each dummy's rows."""
    table, features = _forest_table(spark, sf_dir)
    dummies = [c for c in features if c.startswith("sic_")]
    sums = table.agg(F.array(*[F.struct(F.lit(int(c[4:])).cast("bigint").alias("code"), F.sum(c).cast("bigint").alias("n_rows"))
                               for c in dummies]).alias("all"))
    return sums.select(F.lit(len(features)).cast("bigint").alias("n_features"), F.inline("all"))


REPORTS = {
    "drift": ("test_year", ["train_end", "n_train", "n_test", "train_y_mean", "train_y_std", "test_y_mean", "test_y_std"]),
    "yearly": ("year", ["n", "y_mean", "pred_mean", "y_std", "pred_std", "corr_y_pred", "sse", "sst_zero", "r2_pct"]),
    "yearly_r2": ("target_year", ["r2_pct"]),
    "quantiles": (None, [f"{c}_p{p}" for c in ("y", "pred") for p in ("01", "50", "99")]),
    "r2_summary": (None, ["r2_all_pct", "r2_top1000_pct", "r2_bottom1000_pct", "n_obs"]),
}


def run_report(spark, sf_dir):
    """A whole linear run stored and reported: every number of its five reports, read back from their files."""
    folder = scratch_path(spark, "run")
    wf.run_linear(tb.panel(spark, sf_dir), folder, test_years=TEST_YEARS, gap=GAP, first=tb.FIRST_TARGET, last=tb.LAST_TARGET)
    found = None
    for name, (key, measures) in REPORTS.items():
        table = read_csv_clean(spark, f"{folder}/{name}_OLS3_Huber_next_month.csv")
        numbers = F.array(*[F.struct(F.lit(c).alias("measure"), rounded(clean.strict_double(F.col(c)), 4).alias("value")) for c in measures])
        year = clean.strict_long(F.col(key)) if key else F.lit(0).cast("bigint")
        part = table.select(F.lit(name).alias("report"), year.alias("year"), F.inline(numbers))
        found = part if found is None else found.unionByName(part)
    return found


QUERIES = {f.__name__: f for f in [
    null_tokens_trim, lenient_cast, strict_cast, parse_dates, month_index, yyyymm_split, csv_parquet_roundtrip,
    prediction_store, prediction_concat, summary_csv, delist_adjusted_return, market_cap, security_codes, lag_by_row,
    risk_free, macro_predictors, master_panel, excess_return, macro_resolution, key_uniqueness, panel_qa,
    panel_coverage, next_month_target, colocated_panel, colocated_target, same_month_target, month_median_fill, rank_transform, rank_transform_float,
    rank_transform_split, ranks_with_nulls, ranks_with_nulls_split, wide_rank_transform, wide_rank_transform_split, macro_global_fill,
    macro_expanding_fill, macro_interactions, industry_dummies, finite_pairs, top_bottom_k, oos_r2_summary, yearly_r2, yearly_diagnostics, forecast_quantiles,
    forecast_quantiles_split, forecast_quantiles_disc, forecast_quantiles_linear, drift_table, huber_loss_terms, expanding_window_ols, huber_thresholds,
    huber_coefficients, huber_walkforward, huber_r2, gbt_walkforward, gbt_base_value, gbt_trees, gbt_forecasts, forest_trees, forest_forecasts,
    forest_walkforward, forest_features, run_report]}
