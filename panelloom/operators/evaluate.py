"""Scoring forecasts and reporting on panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.constants import VALUES_PER_TASK, SEGMENT_SIZE
from panelloom.functions.cleaning import is_finite
from panelloom.operators.orderstats import group_quantiles


def r2_against_zero(y: Column, prediction: Column) -> Column:
    """Aggregate: 1 - SSE / sum of squared targets over finite pairs; NULL if that sum is zero."""
    usable = is_finite(y) & is_finite(prediction)
    y, prediction = y.cast("double"), prediction.cast("double")
    sse = F.sum(F.when(usable, (y - prediction) * (y - prediction)))
    sst = F.sum(F.when(usable, y * y))
    return F.lit(1.0) - F.try_divide(sse, sst)


def first_in_group(df: DataFrame, group: list[str], order: list[Column], k: int, parts: int | None = None,
                   rank: str = "size_rank") -> DataFrame:
    """The first `k` rows of each group in `order`, numbered from 1 in column `rank`.

    Two rounds. Rows are sliced by the task that reads them, which leaves at most `k` per group and
    task to shuffle (Spark trims them beforehand) and shares a large group out over `parts` tasks
    (as many as the session's shuffle partitions unless given, 256 at least); the second round then sees at most `k * parts` rows of any group. How rows are sliced does not
    matter to the result. `order` must be total for a repeatable one.
    """
    parts = parts or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    within = W.partitionBy(*group, "_part").orderBy(*order)
    short = slices.withColumn("_row", F.row_number().over(within)).filter(F.col("_row") <= k)
    overall = W.partitionBy(*group).orderBy(*order)
    return (short.drop("_row", "_part").withColumn(rank, F.row_number().over(overall))
                 .filter(F.col(rank) <= k))


def largest_and_smallest(preds: DataFrame, k: int = SEGMENT_SIZE, size: str = "size_for_ranking",
                         group: str = "target_month_id", entity: str = "permno") -> DataFrame:
    """The `k` largest and the `k` smallest entities of every month, labelled in `segment`.

    An entity without a size is in neither; in a month of fewer than 2k it may be in both.
    """
    sized = preds.filter(F.col(size).isNotNull())
    ends = {"top": F.col(size).desc(), "bottom": F.col(size).asc()}
    top, bottom = (
        first_in_group(sized, [group], [direction, F.col(entity).asc()], k)
        .withColumn("segment", F.lit(label)) for label, direction in ends.items())
    return top.unionByName(bottom)


def r2_summary(preds: DataFrame, model: str, target_mode: str, k: int = SEGMENT_SIZE,
               n_features: int | None = None, prediction_file: str | None = None) -> DataFrame:
    """One row: R2 in percent over all rows, the largest and the smallest entities, and counts."""
    scored = preds.select("permno", "target_month_id", "size_for_ranking", "y", "prediction")
    segments = scored.withColumn("segment", F.lit("all")).unionByName(
        largest_and_smallest(scored, k).drop("size_rank"))
    per_segment = segments.groupBy("segment").agg(
        (100 * r2_against_zero(F.col("y"), F.col("prediction"))).alias("r2"),
        F.count(F.lit(1)).alias("n"))

    def of(segment: str, column: str) -> Column:
        return F.max(F.when(F.col("segment") == segment, F.col(column)))

    summary = per_segment.agg(
        of("all", "r2").alias("r2_all_pct"),
        of("top", "r2").alias(f"r2_top{k}_pct"),
        of("bottom", "r2").alias(f"r2_bottom{k}_pct"),
        F.coalesce(of("all", "n"), F.lit(0)).alias("n_obs"))
    extra = []
    if n_features is not None:
        extra.append(F.lit(n_features).alias("n_features"))
    if prediction_file is not None:
        extra.append(F.lit(prediction_file).alias("prediction_file"))
    return summary.select(F.lit(model).alias("model"), F.lit(target_mode).alias("target_mode"), "*", *extra)


def yearly_r2(preds: DataFrame, year: str = "target_year") -> DataFrame:
    return preds.groupBy(year).agg(
        (100 * r2_against_zero(F.col("y"), F.col("prediction"))).alias("r2_pct"))


def yearly_diagnostics(preds: DataFrame) -> DataFrame:
    """Moments, correlation and R2 of target and forecast per target year."""
    y, p = F.col("y"), F.col("prediction").cast("double")
    return (preds.groupBy(F.year("target_month").cast("bigint").alias("year")).agg(
                F.count(F.lit(1)).alias("n"),
                F.avg(y).alias("y_mean"), F.avg(p).alias("pred_mean"),
                F.stddev_samp(y).alias("y_std"), F.stddev_samp(p).alias("pred_std"),
                F.corr(y, p).alias("corr_y_pred"),
                F.sum((y - p) * (y - p)).alias("sse"), F.sum(y * y).alias("sst_zero"))
            .select("*", (100 * (1 - F.try_divide("sse", "sst_zero"))).alias("r2_pct"))
            .orderBy("year"))


def forecast_quantiles(preds: DataFrame, probs: list[float] = (0.01, 0.5, 0.99), method: str = "nearest",
                       values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """One row: the quantiles of target and forecast over all rows."""
    found = group_quantiles(preds.select("y", "prediction"), [], ["y", "prediction"], list(probs),
                            method, values_per_task)
    return found.agg(*[
        F.max(F.when(F.col("feature") == c, F.get("q", F.lit(i)))).alias(f"{short}_p{round(100 * p):02d}")
        for c, short in enumerate(["y", "pred"]) for i, p in enumerate(probs)])


def drift_table(df: DataFrame, windows: list[tuple[int, int]], year: str = "target_year",
                y: str = "y") -> DataFrame:
    """Mean, population deviation and count of the target, training window against test year.

    Windows overlap, so rows are reduced to one line of sums per year first, and the lines are
    added up per window: `windows` holds (test year, last training year).
    """
    yearly = df.filter(F.col(y).isNotNull()).groupBy(year).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("spread"))
    sides = F.explode(F.array(*[
        F.struct(F.lit(t).cast("bigint").alias("test_year"), F.lit(e).cast("bigint").alias("train_end"),
                 F.when(F.col(year) == t, "test").when(F.col(year) <= e, "train").alias("side"))
        for t, e in windows]))
    lines = yearly.select("*", sides.alias("w")).select("n", "mean", "spread", "w.*")
    lines = lines.filter(F.col("side").isNotNull())
    # deviations of a union of years: within each year plus between the years
    totals = lines.groupBy("test_year", "train_end", "side").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum("spread").alias("within"),
        (F.sum(F.col("n") * F.col("mean") * F.col("mean"))
         - F.sum(F.col("n") * F.col("mean")) * F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("between"))
    std = F.sqrt((F.col("within") + F.greatest("between", F.lit(0.0))) / F.col("n"))

    def of(side: str, value: Column) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    return totals.groupBy("test_year", "train_end").agg(
        of("train", F.col("mean")).alias("train_y_mean"), of("train", std).alias("train_y_std"),
        of("test", F.col("mean")).alias("test_y_mean"), of("test", std).alias("test_y_std"),
        F.coalesce(of("train", F.col("n")), F.lit(0)).alias("n_train"),
        F.coalesce(of("test", F.col("n")), F.lit(0)).alias("n_test")).orderBy("test_year")


def panel_qa(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("permno").alias("n_permnos"),
        F.min("month").alias("min_month"), F.max("month").alias("max_month"),
        F.count_if(F.col("ret_excess").isNull()).alias("missing_ret_excess"),
        F.count_if(F.col("mktcap_lag").isNull()).alias("missing_mktcap_lag"))


def panel_coverage(panel: DataFrame) -> DataFrame:
    return (panel.groupBy(F.year("month").cast("bigint").alias("year"))
                 .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("permno").alias("n_stocks"))
                 .orderBy("year"))
