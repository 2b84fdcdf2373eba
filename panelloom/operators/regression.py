"""Linear regression over expanding training windows: least squares and fixed-threshold Huber loss.

A window is (test year, last training year). All windows are fitted together and rows are only
ever summed:

* least squares needs one pass: sums of products per target year, added up over the years;
* the Huber fit takes Newton steps. Inside the threshold the loss is quadratic, beyond it linear, so a
  step solves the least-squares system of the rows inside with a constant pull from those beyond; once the
  same rows are beyond, the next point is the minimum. A pass sums up the few rows beyond and corrects the
  least-squares sums with them. Rows whose |y| cannot exceed the threshold in any window are left
  out by a filter that reaches the parquet scan.

Only those sums (years or windows x a few numbers) come to the driver.
"""

from __future__ import annotations

import itertools
import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.constants import HUBER_FLOOR, HUBER_QUANTILE, VALUES_PER_TASK
from panelloom.functions.cleaning import is_finite
from panelloom.operators.orderstats import group_quantiles
from panelloom.sources.storage import materialize

Window = tuple[int, int]


@dataclass
class LinearFit:
    """Coefficients for one window, intercept first."""
    test_year: int
    train_end: int
    n: int
    beta: np.ndarray
    xi: float = math.inf
    passes: int = 0
    gradient: float = field(default=0.0)
    #: The point that the next pass looks at, and the loss at `beta`.
    trial: np.ndarray | None = None
    loss: float = math.inf


def usable_rows(df: DataFrame, features: list[str], year: str = "target_year", y: str = "y") -> DataFrame:
    """Year, target and features as doubles, complete and finite rows only."""
    complete = is_finite(F.col(y))
    for c in features:
        complete = complete & is_finite(F.col(c))
    return df.filter(complete).select(
        F.col(year).cast("bigint").alias("year"), F.col(y).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(features)])


def _training_rows(df: DataFrame, features: list[str], windows: list[Window], year: str, y: str) -> DataFrame:
    """Usable rows of the years that any window trains on; later partitions are not read."""
    return usable_rows(df, features, year, y).filter(F.col("year") <= max(end for _, end in windows))


def _design(p: int) -> list[Column]:
    return [F.lit(1.0)] + [F.col(f"x{i + 1}") for i in range(p)]


def _product_sums(p: int) -> list[Column]:
    """Aggregates a_i_j (i <= j) and b_i: sums of x_i x_j and x_i y."""
    x = _design(p)
    pairs = itertools.combinations_with_replacement(range(p + 1), 2)
    return ([F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i, j in pairs]
            + [F.sum(x[i] * F.col("y")).alias(f"b_{i}") for i in range(p + 1)])


def _as_matrices(row, p: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((p + 1, p + 1))
    for i, j in itertools.combinations_with_replacement(range(p + 1), 2):
        a[i, j] = a[j, i] = row[f"a_{i}_{j}"]
    return a, np.array([row[f"b_{i}"] for i in range(p + 1)])


def yearly_product_sums(rows: DataFrame, p: int) -> DataFrame:
    """One line per year: counts, sums of products and the largest magnitude of every feature."""
    return rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *_product_sums(p),
        *[F.max(F.abs(f"x{i + 1}")).alias(f"top_{i + 1}") for i in range(p)])


def _window_sums(yearly: list, windows: list[Window], p: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    out = {}
    for test_year, train_end in windows:
        used = [r for r in yearly if r["year"] <= train_end]
        if not used:
            raise ValueError(f"No usable training rows up to {train_end} for test year {test_year}")
        parts = [_as_matrices(r, p) for r in used]
        out[test_year] = (sum(r["n"] for r in used), sum(a for a, _ in parts), sum(b for _, b in parts))
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _solve_closely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`_solve`, corrected once: a line of small sums would else keep the rounding of the largest ones, more than a fit's tolerance."""
    found = _solve(a, b)
    return found + _solve(a, b - a @ found)


def fit_least_squares(df: DataFrame, features: list[str], windows: list[Window],
                      year: str = "target_year", y: str = "y") -> list[LinearFit]:
    p = len(features)
    yearly = yearly_product_sums(_training_rows(df, features, windows, year, y), p).collect()
    sums = _window_sums(yearly, windows, p)
    return [LinearFit(t, e, sums[t][0], _solve(sums[t][1], sums[t][2])) for t, e in windows]


def window_rows(rows: DataFrame, windows: list[Window], extra: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """Every row once per window it trains, with `test_year` and the window's `extra` numbers.

    A row is repeated in place (at most once per window), ready to be summed by `test_year`.
    """
    options = F.array(*[
        F.struct(F.lit(t).cast("bigint").alias("test_year"), F.lit(e).cast("bigint").alias("train_end"),
                 *[F.lit(float(v)).alias(k) for k, v in (extra or {}).get(t, {}).items()])
        for t, e in windows])
    mine = F.filter(options, lambda w: F.col("year") <= w["train_end"])
    return rows.select("*", F.inline(mine))


def huber_thresholds(rows: DataFrame, windows: list[Window], quantile: float = HUBER_QUANTILE,
                     values_per_task: int = VALUES_PER_TASK) -> dict[int, float]:
    """Test year -> interpolated quantile of |y| over its training rows.

    Only the largest |y| matter. In each year the share 1 - quantile lies above that year's own quantile, so the least
    of the yearly quantiles, sketched a little low, bounds every window's from below; counts confirm it. Rows beyond
    the bound are found by a filter that reaches the scan, and only these are repeated for their windows.
    """
    size = F.abs("y")
    accuracy = min(1_000_000, math.ceil(20 / (1 - quantile))) if quantile < 1 else 1_000_000
    low = max(0.0, quantile - 0.25 * (1 - quantile))
    yearly = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(size, low, accuracy).alias("low")).collect()
    bound = min((r["low"] for r in yearly), default=0.0)
    total = {t: sum(r["n"] for r in yearly if r["year"] <= end) for t, end in windows}
    top = materialize(rows_beyond(rows, bound).select("year", size.alias("abs_y")), "largest")
    beyond = {r["year"]: r["n"] for r in top.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = {}
    for t, end in windows:
        n_top = sum(n for y, n in beyond.items() if y <= end)
        spot = quantile * (total[t] - 1) - (total[t] - n_top)
        if total[t] and spot < 0:  # the sketch was too high after all: look at every row
            return huber_thresholds_of_all(rows, windows, quantile, values_per_task)
        place[t] = spot / (n_top - 1) if n_top > 1 else 0.0
    probs = sorted(set(place.values()))
    found = group_quantiles(window_rows(top, windows), ["test_year"], ["abs_y"], probs, "linear", values_per_task).collect()
    return _usable_thresholds({r["test_year"]: r["q"][probs.index(place[r["test_year"]])] for r in found})


def huber_thresholds_of_all(rows: DataFrame, windows: list[Window], quantile: float = HUBER_QUANTILE,
                            values_per_task: int = VALUES_PER_TASK) -> dict[int, float]:
    """The same from every row, repeated for its windows."""
    sizes = window_rows(rows.select("year", F.abs("y").alias("abs_y")), windows)
    found = group_quantiles(sizes, ["test_year"], ["abs_y"], [quantile], "linear", values_per_task).collect()
    return _usable_thresholds({r["test_year"]: r["q"][0] for r in found})


def _usable_thresholds(xi: dict[int, float]) -> dict[int, float]:
    return {t: v if math.isfinite(v) and v > 0 else HUBER_FLOOR for t, v in xi.items()}


def rows_beyond(rows: DataFrame, reach: float) -> DataFrame:
    """Rows whose |y| may exceed `reach`, a little slack included; stated on `y` so that the scan can skip."""
    low = reach * (1 - 1e-9)
    return rows if reach <= 0 else rows.filter((F.col("y") > low) | (F.col("y") < -low))


@dataclass
class _Beyond:
    """Sums over the rows of a window whose residual is beyond the threshold: products, signed x, loss less squared residual."""
    a: np.ndarray | float = 0.0
    b: np.ndarray | float = 0.0
    pull: np.ndarray | float = 0.0
    excess: float = 0.0


def _beyond_sums(rows: DataFrame, active: list[LinearFit], p: int, top: np.ndarray) -> dict[int, _Beyond]:
    """Per test year, at the fits' trial points."""
    reach = min(f.xi - float(np.abs(f.trial) @ top) for f in active)
    near = rows_beyond(rows, reach)
    extra = {f.test_year: {"xi": f.xi, **{f"beta_{i}": v for i, v in enumerate(f.trial)}} for f in active}
    spread = window_rows(near, [(f.test_year, f.train_end) for f in active], extra)
    fitted = sum((F.col(f"beta_{i}") * x for i, x in enumerate(_design(p))), F.lit(0.0))
    size, sign = F.abs("residual"), F.signum("residual")
    beyond = spread.withColumn("residual", F.col("y") - fitted).filter(size > F.col("xi"))
    got = beyond.groupBy("test_year").agg(
        *_product_sums(p), *[F.sum(sign * x).alias(f"pull_{i}") for i, x in enumerate(_design(p))],
        F.sum(2 * F.col("xi") * size - F.col("xi") * F.col("xi") - size * size).alias("excess")).collect()
    return {r["test_year"]: _Beyond(*_as_matrices(r, p), np.array([r[f"pull_{i}"] for i in range(p + 1)]), r["excess"]) for r in got}


def fit_huber(df: DataFrame, features: list[str], windows: list[Window], quantile: float = HUBER_QUANTILE,
              tolerance: float = 1e-11, max_passes: int = 100, year: str = "target_year", y: str = "y",
              values_per_task: int = VALUES_PER_TASK) -> list[LinearFit]:
    """Minimise the mean Huber loss per window, the threshold fixed beforehand.

    Newton steps from the least-squares start, all windows in the same passes: a handful, reported in `passes`. A step that
    doesn't lower the loss is halved. `tolerance` bounds the largest slope of the mean loss, relative to the threshold and
    to the largest magnitude of the slope's feature.
    """
    p = len(features)
    rows = _training_rows(df, features, windows, year, y)
    yearly = yearly_product_sums(rows, p).collect()
    sums = _window_sums(yearly, windows, p)
    squares = {t: sum(r["yy"] for r in yearly if r["year"] <= end) for t, end in windows}
    top = np.array([1.0] + [max(r[f"top_{i + 1}"] for r in yearly) for i in range(p)])
    xi = huber_thresholds(rows, windows, quantile, values_per_task)
    fits = [LinearFit(t, e, sums[t][0], _solve(sums[t][1], sums[t][2]), xi[t]) for t, e in windows]
    for f in fits:
        f.trial = f.beta
    active = list(fits)
    for done in range(1, max_passes + 1):
        found = _beyond_sums(rows, active, p, top)
        still = []
        for f in active:
            n, a, b = sums[f.test_year]
            beyond = found.get(f.test_year, _Beyond())
            loss = squares[f.test_year] - 2 * float(b @ f.trial) + float(f.trial @ a @ f.trial) + beyond.excess
            f.passes = done
            if loss > f.loss + 1e-12 * squares[f.test_year]:
                f.trial = (f.beta + f.trial) / 2
                still.append(f)
                continue
            f.beta, f.loss = f.trial, loss
            inside, goal = a - beyond.a, b - beyond.b + f.xi * beyond.pull
            f.gradient = float((np.abs(2 * (goal - inside @ f.beta)) / np.maximum(top, 1)).max() / n)
            if f.gradient > tolerance * f.xi:
                f.trial = _solve_closely(inside, goal)
                still.append(f)
        active = still
        if not active:
            return fits
    warnings.warn(f"Huber fit not converged after {max_passes} passes for test years "
                  f"{[f.test_year for f in active]}", RuntimeWarning, stacklevel=2)
    return fits


def coefficients(spark, fits: list[LinearFit], features: list[str]) -> DataFrame:
    """One line per window: test year, last training year, rows, threshold and coefficients."""
    names = ["intercept"] + features
    schema = "test_year bigint, train_end bigint, n_train bigint, xi double, " + ", ".join(
        f"`{c}` double" for c in names)
    return spark.createDataFrame(
        [(f.test_year, f.train_end, int(f.n), float(f.xi), *map(float, f.beta)) for f in fits], schema)


def predict_linear(df: DataFrame, fits: list[LinearFit], features: list[str],
                   year: str = "target_year") -> DataFrame:
    """Rows of the test years with `prediction` and `train_end_year`; other years drop out.

    The coefficients travel as one line per test year.
    """
    lines = coefficients(df.sparkSession, fits, features).select(
        F.col("test_year").alias(year), F.col("train_end").cast("int").alias("train_end_year"),
        F.array("intercept", *[F.col(f"`{c}`") for c in features]).alias("_beta"))
    value = F.get("_beta", F.lit(0))
    for i, c in enumerate(features):
        value = value + F.get("_beta", F.lit(i + 1)) * F.col(c)
    joined = df.join(F.broadcast(lines), year, "inner")
    return joined.select(*df.columns, value.alias("prediction"), "train_end_year")
