import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import regression as rg
from panelloom.operators import trees
from panelloom.plans import walkforward as wf
from panelloom.sources.storage import materialize

X = ["x_rank", "z_rank"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 3000
    x, z = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
    year = np.where(rng.random(n) < 0.34, 1990, rng.integers(1991, 2001, n))
    return pd.DataFrame({
        "permno": np.arange(n), "month_id": year * 12 + 1, "month": [datetime.date(int(t), 1, 1) for t in year],
        "target_month": [datetime.date(int(t), 2, 1) for t in year], "target_month_id": year * 12 + 2,
        "target_year": year, "size_for_ranking": rng.lognormal(size=n), "x_rank": x, "z_rank": z,
        "y": 0.1 + 0.5 * x - 0.3 * (z > 0) + rng.standard_t(2, n) * 0.2})


@pytest.fixture(scope="module")
def table(spark, sample):
    return materialize(spark.createDataFrame(sample), "sample", ["target_year"])


def huber(a, y, xi):
    """Plain reweighting on arrays, for comparison."""
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(2000):
        e = np.abs(y - a @ beta)
        w = np.where(e <= xi, 1.0, xi / np.maximum(e, 1e-300))
        beta = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
    return beta


@pytest.mark.parametrize("limit", [4_000_000, 200])
@pytest.mark.parametrize("share", [0.999, 0.8])
def test_huber_fit_reaches_the_minimum(sample, table, share, limit):
    windows = [(1995, 1992), (2000, 1998)]
    for fit in rg.fit_huber(table, X, windows, share, values_per_task=limit):
        part = sample[sample.target_year <= fit.train_end]
        a, y = np.column_stack([np.ones(len(part)), part[X]]), part.y.to_numpy()
        xi = np.quantile(np.abs(y), share)
        assert fit.n == len(part) and fit.xi == pytest.approx(xi, rel=1e-12)
        assert fit.beta == pytest.approx(huber(a, y, xi), abs=1e-8)
        e = y - a @ fit.beta
        slope = -2 * a.T @ np.clip(e, -xi, xi) / len(y)
        assert np.abs(slope).max() < 1e-9
        assert fit.passes <= 12


def test_passes_read_only_training_years_and_rows_beyond_the_threshold(table):
    rows = rg.rows_beyond(rg._training_rows(table, X, [(1995, 1992)], "target_year", "y"), 2.0)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "target_year" in plan.split("PartitionFilters:")[1].split("]")[0] and "<= 1992" in plan
    assert "Or(GreaterThan(y,1.9" in plan and "LessThan(y,-1" in plan  # the plan's text is cut off there


def test_newton_steps_that_overshoot_are_halved(spark):
    """Two clusters far apart and a threshold far below: the least-squares start has most rows beyond."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=60), rng.normal(size=40) * 30]
    y = np.where(np.arange(100) < 60, 3 * x, -40 * x) + rng.normal(size=100)
    frame = spark.createDataFrame([(1990, float(b), float(a), float(a * a)) for a, b in zip(x, y)], "target_year int, y double, x_rank double, z_rank double")
    fit, = rg.fit_huber(frame, X, [(1995, 1992)], 0.05)
    a = np.column_stack([np.ones(100), x, x * x])
    slope = -2 * a.T @ np.clip(y - a @ fit.beta, -fit.xi, fit.xi) / 100
    assert (np.abs(slope) / np.abs(a).max(axis=0)).max() < 1e-9 * fit.xi and 20 < fit.passes < 60


def test_a_step_is_exact_in_lines_of_small_sums():
    """Newton steps ended above the tolerance, or did not, by the order in which sums were added up."""
    rng = np.random.default_rng(2)
    left = 0
    for _ in range(200):
        x = np.r_[rng.normal(size=60), rng.normal(size=40) * 300]
        design = np.column_stack([np.ones(100), x, x * x])
        a, b = design.T @ design, design.T @ (-40 * x + rng.normal(size=100))

        def small(beta):
            return abs((b - a @ beta)[0]) / (np.abs(a[0]) @ np.abs(beta) + abs(b[0]))

        left = max(left, small(rg._solve(a, b)))
        assert small(rg._solve_closely(a, b)) < 1e-14
    assert left > 1e-14
    flat = np.outer([1.0, 2.0], [1.0, 2.0])
    assert np.allclose(rg._solve_closely(flat, np.array([5.0, 10.0])), [1, 2])  # the shortest of many solutions


def test_least_squares_windows(sample, table):
    for fit in rg.fit_least_squares(table, X, [(1995, 1992), (2000, 1998)]):
        part = sample[sample.target_year <= fit.train_end]
        a = np.column_stack([np.ones(len(part)), part[X]])
        assert fit.beta == pytest.approx(np.linalg.lstsq(a, part.y, rcond=None)[0], abs=1e-10)


def test_unusable_rows_are_left_out_and_empty_windows_fail(spark, table, sample):
    spoiled = table.withColumn("x_rank", F.when(F.col("permno") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("x_rank")))
    fit, = rg.fit_least_squares(spoiled, X, [(2000, 1998)])
    assert fit.n == ((sample.target_year <= 1998) & (sample.permno % 3 != 0)).sum()
    with pytest.raises(ValueError, match="No usable training rows"):
        rg.fit_huber(table, X, [(1990, 1980)])


def test_a_stopped_fit_warns_and_a_zero_threshold_gets_a_floor(table, spark):
    with pytest.warns(RuntimeWarning, match="not converged"):
        rg.fit_huber(table, X, [(2000, 1998)], 0.5, max_passes=1)
    flat = spark.createDataFrame([(1990, 0.0, 0.1 * i, 0.2) for i in range(9)],
                                 "target_year int, y double, x_rank double, z_rank double")
    assert rg.fit_huber(flat, X, [(1995, 1992)])[0].xi == 1e-8


def test_linear_predictions(sample, table):
    windows = [(1995, 1992), (2000, 1998)]
    preds = wf.linear_walk_forward(table, X, windows, "lin").toPandas().set_index("permno")
    for fit in rg.fit_huber(table, X, windows):
        part = sample[sample.target_year == fit.test_year].set_index("permno")
        mine = preds[preds.target_year == fit.test_year]
        want = fit.beta[0] + part[X] @ fit.beta[1:]
        assert mine.prediction.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy())
        assert set(mine.train_end_year) == {fit.train_end} and set(mine.model) == {"lin"}
    assert set(preds.target_year) == {1995, 2000}


def test_first_boosting_step_by_hand(sample, table):
    """No sampling, one tree: base and leaves follow from slope and curvature sums."""
    settings = trees.BoostSettings(trees=1, depth=1, row_share=1.0, column_share=1.0, min_child_weight=10)
    model = trees.fit_boosted_trees(table, X, settings)
    y = sample.y.to_numpy()
    slope, curve = (lambda e: e / np.sqrt(1 + e * e)), (lambda e: (1 + e * e) ** -1.5)
    base = -slope(-y).sum() / curve(-y).sum()
    assert model.base == pytest.approx(base)
    values, (column, threshold, low, high) = model.trees[0].values, model.trees[0].root
    left = (sample[column] <= threshold).to_numpy()
    for side, leaf in ((left, low), (~left, high)):
        e = base - y[side]
        assert values[leaf] == pytest.approx(-0.03 * slope(e).sum() / (curve(e).sum() + 10.0))
    # the split found is about as good as the best cut of an exhaustive search
    def gain(mask):
        e = base - y
        parts = [(slope(e[m]).sum() ** 2) / curve(e[m]).sum() for m in (mask, ~mask)]
        return sum(parts)
    best = max(gain((sample[c] <= cut).to_numpy()) for c in X for cut in np.linspace(-0.95, 0.95, 60))
    assert gain(left) > 0.95 * best


def test_boosting_is_repeatable_and_improves(table):
    settings = trees.BoostSettings(trees=6, rate=0.3, min_child_weight=50)
    train = table.filter("target_year <= 1998")
    one, two = (trees.fit_boosted_trees(train.repartition(n), X, settings) for n in (2, 5))
    scored = trees.with_score(trees.with_score(train, one.base, one.trees, "p", 4), two.base, two.trees, "q", 4)
    loss = lambda c: F.avg(F.sqrt(1 + (F.col("y") - c) ** 2) - 1)
    gap, fitted, base = scored.agg(F.max(F.abs(F.col("p") - F.col("q"))), loss(F.col("p")), loss(F.lit(one.base))).first()
    assert gap < 1e-9 and fitted < base


def test_forest_forecasts_stay_within_targets(sample, table):
    settings = trees.ForestSettings(trees=10, min_child_weight=50)
    preds = wf.forest_walk_forward(table, X, [(1999, 1996), (2000, 1997)], settings=settings).toPandas()
    again = wf.forest_walk_forward(table, X, [(1999, 1996), (2000, 1997)], settings=settings).toPandas()
    train = sample[sample.target_year <= 1997].y
    assert preds.prediction.between(train.min(), train.max()).all()
    key = ["permno", "target_month_id"]
    pd.testing.assert_frame_equal(preds.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    with pytest.raises(ValueError, match="No usable training rows"):
        wf.forest_walk_forward(table, X, [(1985, 1980)], settings=settings)


def test_running_score_is_stored_without_changing_the_trees(table, monkeypatch):
    settings = trees.BoostSettings(trees=5, rate=0.3, min_child_weight=50)
    train = table.filter("target_year <= 1998")
    whole = trees.fit_boosted_trees(train, X, settings)
    monkeypatch.setattr(trees, "STORE_EVERY", 2)
    again = trees.fit_boosted_trees(train, X, settings)
    for one, two in zip(whole.trees, again.trees):
        assert one.root == two.root and one.values == pytest.approx(two.values)


def test_forest_leaves_are_shrunk_means(sample, table):
    """One tree, every row: leaves from sums of all rows, drawn towards the mean."""
    settings = trees.ForestSettings(trees=1, depth=1, row_share=1.0, column_share=1.0, node_share=1.0, min_child_weight=10)
    forest = trees.fit_forest(table, X, settings)
    y = sample.y.to_numpy()
    assert forest.base == pytest.approx(y.mean())
    column, threshold, low, high = forest.trees[0].root
    left = (sample[column] <= threshold).to_numpy()
    for side, leaf in ((left, low), (~left, high)):
        assert forest.trees[0].values[leaf] == pytest.approx(y.mean() + (y[side] - y.mean()).sum() / (side.sum() + 10.0))


def test_a_report_holds_its_own_windows_only(spark, table, tmp_path):
    """Years stored by another run, or by one with other settings, are not scored."""
    path = str(tmp_path / "predictions")
    first, second = [(1998, 1995), (1999, 1996)], [(1999, 1996), (2000, 1997)]
    for run, windows in (("a", first), ("b", second)):
        preds = wf.linear_walk_forward(table, X, windows)
        for t, _ in windows:
            wf._store(preds, path, run, t)
    own = wf.read_forecasts(spark, path, "b", second)
    summary = wf.report(own, str(tmp_path), "OLS3_Huber", "next_month", second, table, 5, 3, path).first()
    assert summary["n_obs"] == table.filter("target_year IN (1999, 2000)").count()
    assert wf.stored_years(spark, path, "a", second) == [1999] and wf.stored_years(spark, path, "c", second) == []
    for name in ("yearly", "yearly_r2", "quantiles", "drift"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}_OLS3_Huber_next_month.csv").count() in (1, 2)


def test_thresholds_from_the_largest_rows_equal_those_of_all(sample, table):
    windows = [(1995, 1992), (2000, 1998)]
    rows = rg.usable_rows(table, X)
    for share in (0.5, 0.99, 0.999):
        got, want = rg.huber_thresholds(rows, windows, share), rg.huber_thresholds_of_all(rows, windows, share)
        assert got == pytest.approx(want)
