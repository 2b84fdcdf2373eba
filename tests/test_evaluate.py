import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import evaluate as ev

SCHEMA = ("permno bigint, target_month_id bigint, target_month date, target_year bigint, size_for_ranking double, "
          "y double, prediction double")


def preds(spark, rows):
    """rows: (permno, month, size, y, prediction)"""
    return spark.createDataFrame(
        [(p, 24000 + m, datetime.date(2000 + m // 12, m % 12 + 1, 1), 2000 + m // 12, s, y, f)
         for p, m, s, y, f in rows], SCHEMA)


def r2(df):
    return df.agg(ev.r2_against_zero(F.col("y"), F.col("prediction"))).first()[0]


def test_r2_of_perfect_zero_and_undefined_forecasts(spark):
    rows = [(1, 0, 1.0, 0.5), (2, 0, 1.0, -2.0)]
    assert r2(preds(spark, [(*r, r[3]) for r in rows])) == 1.0
    assert r2(preds(spark, [(*r, 0.0) for r in rows])) == 0.0
    assert r2(preds(spark, [(*r[:3], 0.0, 0.3) for r in rows])) is None
    nan, inf = math.nan, math.inf
    mixed = [(1, 0, 1.0, 1.0, 0.5), (2, 0, 1.0, 1.0, nan), (3, 0, 1.0, nan, 1.0), (4, 0, 1.0, 1.0, inf),
             (5, 0, 1.0, None, 1.0), (6, 0, 1.0, 1.0, None)]
    assert r2(preds(spark, mixed)) == 0.75


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ends_against_pandas(spark, k):
    rng = np.random.default_rng(5)
    rows = [(p, m, None if rng.random() < 0.1 else float(rng.integers(0, 30)), 0.1, 0.1)
            for m in range(3) for p in range(60 if m else 300)]
    got = ev.largest_and_smallest(preds(spark, rows), k).toPandas()
    sized = pd.DataFrame(rows, columns=["permno", "month", "size", "y", "f"]).dropna(subset="size")
    for month, part in sized.groupby("month"):
        for segment, up in (("top", False), ("bottom", True)):
            want = list(part.sort_values(["size", "permno"], ascending=[up, True]).permno[:k])
            mine = got[(got.segment == segment) & (got.target_month_id == 24000 + month)].sort_values("size_rank")
            assert list(mine.permno) == want and len(want) == min(k, len(part))


def test_summary_over_all_and_both_ends(spark):
    rows = [(1, 0, 10.0, 1.0, 1.0), (2, 0, 5.0, 1.0, 0.0), (3, 0, None, 1.0, 0.5), (4, 0, 7.0, 2.0, 1.0)]
    got = ev.r2_summary(preds(spark, rows), "m", "next_month", 1, 3, "file").first().asDict()
    assert got == {"model": "m", "target_mode": "next_month", "r2_all_pct": pytest.approx(100 * (1 - 2.25 / 7)),
                   "r2_top1_pct": 100.0, "r2_bottom1_pct": 0.0, "n_obs": 4, "n_features": 3, "prediction_file": "file"}


def test_first_round_trims_before_its_shuffle(spark, tmp_path):
    path = str(tmp_path / "p")
    preds(spark, [(1, 0, 1.0, 1.0, 1.0)]).write.parquet(path)
    plan = ev.largest_and_smallest(spark.read.parquet(path), 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_diagnostics_and_yearly_r2(spark):
    rng = np.random.default_rng(6)
    rows = [(p, m, 1.0, float(rng.normal()), float(rng.normal())) for m in range(24) for p in range(5)]
    got = ev.yearly_diagnostics(preds(spark, rows)).toPandas()
    data = pd.DataFrame(rows, columns=["p", "m", "s", "y", "f"])
    for (year, part), (_, row) in zip(data.groupby(2000 + data.m // 12), got.iterrows()):
        assert row["year"] == year and row["n"] == len(part)
        assert row["y_std"] == pytest.approx(part.y.std()) and row["corr_y_pred"] == pytest.approx(part.y.corr(part.f))
        assert row["r2_pct"] == pytest.approx(100 * (1 - ((part.y - part.f) ** 2).sum() / (part.y ** 2).sum()))
    yearly = {r["target_year"]: r["r2_pct"] for r in ev.yearly_r2(preds(spark, rows)).collect()}
    assert yearly == pytest.approx(dict(zip(got.year, got.r2_pct)))


def test_drift_adds_up_years_exactly(spark):
    rng = np.random.default_rng(7)
    data = pd.DataFrame({"target_year": rng.integers(1990, 2000, 500), "y": rng.normal(100, 0.01, 500)})
    windows = [(1995, 1991), (1999, 1996), (2005, 1999)]
    got = ev.drift_table(spark.createDataFrame(data), windows).toPandas().set_index("test_year")
    for test, end in windows:
        train = data[data.target_year <= end].y
        row = got.loc[test]
        assert row["n_train"] == len(train) and row["train_y_mean"] == pytest.approx(train.mean())
        assert row["train_y_std"] == pytest.approx(train.std(ddof=0), rel=1e-6)
        assert row["n_test"] == (data.target_year == test).sum()
    assert pd.isna(got.loc[2005, "test_y_mean"])


def test_forecast_quantiles(spark):
    rows = [(p, 0, 1.0, float(p), float(-p)) for p in range(101)]
    got = ev.forecast_quantiles(preds(spark, rows), method="linear").first().asDict()
    assert got == {"y_p01": 1.0, "y_p50": 50.0, "y_p99": 99.0, "pred_p01": -99.0, "pred_p50": -50.0, "pred_p99": -1.0}
