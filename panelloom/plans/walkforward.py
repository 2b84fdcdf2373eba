"""Expanding walk-forward: fit on the past, forecast one year, score all years."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.constants import (CHARACTERISTICS, HUBER_QUANTILE, ID_COLUMNS, LINEAR_CHARACTERISTICS,
                                 LINEAR_TEST_YEARS, MACROS, SEGMENT_SIZE, TRAIN_GAP, VALUES_PER_TASK,
                                 TREE_TEST_YEARS)
from panelloom.operators.evaluate import (drift_table, forecast_quantiles, r2_summary, yearly_diagnostics,
                                         yearly_r2)
from panelloom.operators.histograms import even_cuts
from panelloom.operators.regression import fit_huber, predict_linear
from panelloom.operators.trees import (BoostedTrees, BoostSettings, Forest, ForestSettings, fit_boosted_windows,
                                       fit_forest_windows, predict_boosted, predict_forest)
from panelloom.plans.prepare import prepare_panel
from panelloom.sources.storage import materialize, scratch
from panelloom.sources.tables import write_finished, write_parquet, write_summary_csv


def walk_forward_windows(test_years: Iterable[int], gap: int = TRAIN_GAP) -> list[tuple[int, int]]:
    """(test year, last training year): the years in between are left out."""
    return [(t, t - gap) for t in test_years]


def split(df: DataFrame, train_max_year: int | None = None, test_year: int | None = None,
          year: str = "target_year") -> DataFrame:
    """Lazily keep training years, a test year, both or all; prunes partitions of a stored table."""
    if train_max_year is not None:
        df = df.filter(F.col(year) <= train_max_year)
    if test_year is not None:
        df = df.filter(F.col(year) == test_year)
    return df


def label_predictions(df: DataFrame, model: str, train_end: int | None = None) -> DataFrame:
    """Ids, prediction, model name and last training year."""
    end = F.col("train_end_year") if train_end is None else F.lit(train_end)
    return df.select(*ID_COLUMNS, "prediction", F.lit(model).alias("model"),
                     end.cast("int").alias("train_end_year"))


def linear_walk_forward(features_table: DataFrame, features: list[str], windows: list[tuple[int, int]],
                        model: str = "OLS3_Huber", quantile: float = HUBER_QUANTILE,
                        values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Huber regressions of all windows fitted together, then one lazy pass of forecasts."""
    fits = fit_huber(features_table, features, windows, quantile, values_per_task=values_per_task)
    return label_predictions(predict_linear(features_table, fits, features), model)


def rank_cuts(features: list[str], bins: int) -> dict[str, np.ndarray]:
    """Bin ends of the features that are ranks within a month: those lie evenly in [-1, 1]."""
    return {c: even_cuts(-1.0, 1.0, bins) for c in features if c.endswith("_rank")}


def boosted_models(features_table: DataFrame, features: list[str], windows: list[tuple[int, int]],
                   settings: BoostSettings = BoostSettings()) -> dict[int, BoostedTrees]:
    """Test year -> model; all windows are fitted in the same passes."""
    fits = fit_boosted_windows(features_table, features, [end for _, end in windows], settings, cuts=rank_cuts(features, settings.bins))
    return {t: fit for (t, _), fit in zip(windows, fits)}


def forest_models(features_table: DataFrame, features: list[str], windows: list[tuple[int, int]],
                  settings: ForestSettings = ForestSettings()) -> dict[int, Forest]:
    fits = fit_forest_windows(features_table, features, [end for _, end in windows], settings, cuts=rank_cuts(features, settings.bins))
    return {t: fit for (t, _), fit in zip(windows, fits)}


def forecasts(features_table: DataFrame, models: dict[int, BoostedTrees | Forest], windows: list[tuple[int, int]],
              predict: Callable[..., DataFrame], model: str, precision: str = "float") -> DataFrame:
    """Each test year's rows with the forecasts of its own model."""
    parts = [label_predictions(predict(split(features_table, test_year=t), models[t], precision=precision), model, end) for t, end in windows]
    return reduce(DataFrame.unionByName, parts)


def boosted_walk_forward(features_table: DataFrame, features: list[str], windows: list[tuple[int, int]],
                         model: str = "GBRT_94_huber", settings: BoostSettings = BoostSettings()) -> DataFrame:
    return forecasts(features_table, boosted_models(features_table, features, windows, settings), windows, predict_boosted, model)


def forest_walk_forward(features_table: DataFrame, features: list[str], windows: list[tuple[int, int]],
                        model: str = "RF_macro", settings: ForestSettings = ForestSettings()) -> DataFrame:
    return forecasts(features_table, forest_models(features_table, features, windows, settings), windows, predict_forest, model)


# -- stored runs ---------------------------------------------------------------------------

def fingerprints(features_table: DataFrame, windows: list[tuple[int, int]], year: str = "target_year") -> dict[int, str]:
    """Test year -> what its window reads, as a digest of the content: rows of its training years and of its test year.

    Rows count with their values in every column, nulls included, and whatever their order; rows of later years than a window's don't
    change it. Sums by year come to the driver.
    """
    columns = [F.col(f"`{c}`") for c in features_table.columns]
    row = F.xxhash64(*columns, F.array(*[c.isNull() for c in columns])).cast("decimal(38,0)")
    lines = features_table.groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("sum")).collect()
    years = sorted((r["year"], r["n"], int(r["sum"])) for r in lines if r["year"] is not None)
    names = sorted(features_table.dtypes)
    return {t: hashlib.sha256(repr((names, end, [y for y in years if y[0] <= end or y[0] == t])).encode()).hexdigest() for t, end in windows}


def _manifest(spark: SparkSession, path: str, run: str, test_year: int) -> str | None:
    """The fingerprint in a finished manifest; None where there is none."""
    folder = f"{path}/run={run}/{test_year}"
    if not (write_finished(spark, folder) and write_finished(spark, f"{folder}/_manifest")):
        return None
    return spark.read.parquet(f"{folder}/_manifest/part-*").first()["fingerprint"]


def stored_years(spark: SparkSession, path: str, run: str, windows: list[tuple[int, int]],
                 prints: dict[int, str] | None = None) -> list[int]:
    """Test years of `windows` whose forecasts a finished write of the same run has left at `path`.

    With `prints` only those whose manifest has the same fingerprint: forecasts of another panel count as missing.
    """
    if prints is None:
        return [t for t, _ in windows if write_finished(spark, f"{path}/run={run}/{t}")]
    return [t for t, _ in windows if _manifest(spark, path, run, t) == prints[t]]


def read_forecasts(spark: SparkSession, path: str, run: str, windows: list[tuple[int, int]]) -> DataFrame:
    """The forecasts of this run's windows and no others."""
    return spark.read.parquet(*[f"{path}/run={run}/{t}" for t, _ in windows])


def _store(forecasts: DataFrame, path: str, run: str, test_year: int, manifest: dict | None = None) -> None:
    """A test year's forecasts, and after them its manifest: the write counts from there on.

    The manifest is a table of one row inside the year's folder, hidden from readers of the forecasts; a new write of the year
    removes it first.
    """
    folder = f"{path}/run={run}/{test_year}"
    write_parquet(forecasts.filter(F.col("target_year") == test_year), folder)
    if manifest is not None:
        line = [(run, manifest["settings"], test_year, manifest["train_end"], manifest["fingerprint"])]
        write_parquet(forecasts.sparkSession.createDataFrame(line, "run string, settings string, test_year int, train_end int, fingerprint string").coalesce(1),
                      f"{folder}/_manifest")


def _manifests(settings: tuple, windows: list[tuple[int, int]], prints: dict[int, str]) -> dict[int, dict]:
    return {t: {"settings": repr(settings), "train_end": end, "fingerprint": prints[t]} for t, end in windows}


def run_name(*settings) -> str:
    """Names a run by its settings: forecasts of other settings are never mixed with it or taken for its own."""
    return hashlib.sha256(repr(settings).encode()).hexdigest()[:12]


def report(preds: DataFrame, folder: str, model: str, mode: str, windows: list[tuple[int, int]], features_table: DataFrame | None = None,
           k: int = SEGMENT_SIZE, n_features: int | None = None, path: str | None = None) -> DataFrame:
    """Everything said about a run, stored as one-file CSVs beside it; returns the R2 summary.

    r2_summary, yearly (moments, correlation, R2), yearly_r2, quantiles of target and forecast, and with the feature
    table drift: the target in the training window against the test year.
    """
    folder = folder.rstrip("/")
    summary = r2_summary(preds, model, mode, k, n_features, path)
    tables = {"r2_summary": summary, "yearly": yearly_diagnostics(preds), "yearly_r2": yearly_r2(preds).orderBy("target_year"),
              "quantiles": forecast_quantiles(preds)}
    if features_table is not None:
        tables["drift"] = drift_table(features_table, windows)
    for name, table in tables.items():
        write_summary_csv(table, f"{folder}/{name}_{model}_{mode}.csv")
    return preds.sparkSession.read.option("header", True).option("inferSchema", True).csv(f"{folder}/r2_summary_{model}_{mode}.csv")


def run_linear(panel: DataFrame, folder: str, mode: str = "next_month",
               columns: list[str] = LINEAR_CHARACTERISTICS, test_years: Iterable[int] = LINEAR_TEST_YEARS,
               gap: int = TRAIN_GAP, **prepare) -> DataFrame:
    name, windows = "OLS3_Huber", walk_forward_windows(test_years, gap)
    settings = (name, mode, columns, gap, prepare)
    path, run = f"{folder.rstrip('/')}/predictions_{name}_{mode}.parquet", run_name(*settings)
    with scratch(panel.sparkSession):
        table, features = prepare_panel(panel, columns, mode, **prepare)
        manifests = _manifests(settings, windows, fingerprints(table, windows))
        preds = materialize(linear_walk_forward(table, features, windows), "forecasts")
        for test_year, _ in windows:
            _store(preds, path, run, test_year, manifests[test_year])
        return report(read_forecasts(panel.sparkSession, path, run, windows), folder, name, mode, windows, table, path=path)


def _run_trees(walk_forward, panel, folder, name, mode, columns, test_years, gap, settings, **prepare):
    """A rerun fits only test years without finished forecasts of the same settings over the same rows, all of them together."""
    spark, windows = panel.sparkSession, walk_forward_windows(test_years, gap)
    path = f"{folder.rstrip('/')}/predictions_{name}_{mode}.parquet"
    named = (name, mode, columns, gap, settings, prepare)
    run = run_name(*named)
    with scratch(spark):
        table, features = prepare_panel(panel, columns, mode, precision="float", **prepare)
        prints = fingerprints(table, windows)
        manifests = _manifests(named, windows, prints)
        done = stored_years(spark, path, run, windows, prints)
        missing = [w for w in windows if w[0] not in done]
        if missing:
            preds = walk_forward(table, features, missing, name, settings)
            for test_year, _ in missing:
                _store(preds, path, run, test_year, manifests[test_year])
        return report(read_forecasts(spark, path, run, windows), folder, name, mode, windows, table, n_features=len(features), path=path)


def run_boosted(panel: DataFrame, folder: str, mode: str = "next_month", columns: list[str] = CHARACTERISTICS,
                test_years: Iterable[int] = TREE_TEST_YEARS, gap: int = TRAIN_GAP,
                settings: BoostSettings = BoostSettings(), **prepare) -> DataFrame:
    return _run_trees(boosted_walk_forward, panel, folder, "GBRT_94_huber", mode, columns, test_years, gap,
                      settings, **prepare)


def run_forest(panel: DataFrame, folder: str, mode: str = "next_month", columns: list[str] = CHARACTERISTICS,
               macros: list[str] = MACROS, test_years: Iterable[int] = TREE_TEST_YEARS, gap: int = TRAIN_GAP,
               settings: ForestSettings = ForestSettings(), **prepare) -> DataFrame:
    """With `industry="sic2"` the dummies of its codes join the ranks and interactions."""
    return _run_trees(forest_walk_forward, panel, folder, "RF_macro", mode, columns, test_years, gap,
                      settings, macros=macros, **prepare)
