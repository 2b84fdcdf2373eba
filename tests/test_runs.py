"""The three model runs end to end on the driver's smallest tables."""

import os

import pytest

from panelloom.operators.trees import BoostSettings, ForestSettings
from panelloom.plans import walkforward as wf
from panelloom.sources import storage
from panelloom.sources.storage import materialize
from workload import tables as tb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
YEARS = dict(test_years=[2000, 2001], gap=2, first=tb.FIRST_TARGET, last=tb.LAST_TARGET)


@pytest.fixture(scope="module")
def panel(spark):
    return materialize(tb.panel(spark, SF), "panel")


def check(spark, summary, folder, model, n_features=None):
    row = summary.first()
    preds = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/predictions_{model}_next_month.parquet")
    assert {p.split("_")[0] for p in os.listdir(folder)} == {"predictions", "r2", "yearly", "quantiles", "drift"}
    assert row["n_obs"] == preds.count() > 0 and row["model"] == model
    assert {r[0] for r in preds.select("target_year").distinct().collect()} == {2000, 2001}
    assert {r[0] for r in preds.select("train_end_year").distinct().collect()} == {1998, 1999}
    assert preds.filter("prediction IS NULL").count() == 0
    if n_features:
        assert row["n_features"] == n_features
    csv = spark.read.option("header", True).csv(f"{folder}/r2_summary_{model}_next_month.csv").first()
    assert int(csv["n_obs"]) == row["n_obs"] and "r2_top1000_pct" in csv.asDict()


def test_linear_run(spark, panel, tmp_path):
    check(spark, wf.run_linear(panel, str(tmp_path), **YEARS), str(tmp_path), "OLS3_Huber")


def test_boosted_run(spark, panel, tmp_path):
    settings = BoostSettings(trees=2, min_child_weight=20)
    summary = wf.run_boosted(panel, str(tmp_path), columns=tb.CHARACTERISTICS, settings=settings, **YEARS)
    check(spark, summary, str(tmp_path), "GBRT_94_huber", 6)


def test_forest_run(spark, panel, tmp_path):
    settings = ForestSettings(trees=4, min_child_weight=20)
    codes = panel.select("sic2").distinct().filter("sic2 IS NOT NULL").count()
    summary = wf.run_forest(panel, str(tmp_path), columns=tb.FEATURES, settings=settings, industry="sic2", **YEARS)
    check(spark, summary, str(tmp_path), "RF_macro")
    assert 27 < summary.first()["n_features"] <= 27 + codes


def test_a_rerun_fits_only_missing_years(spark, panel, tmp_path, monkeypatch):
    settings = BoostSettings(trees=1, min_child_weight=20)
    wf.run_boosted(panel, str(tmp_path), columns=tb.FEATURES, settings=settings, **{**YEARS, "test_years": [2000]})
    fitted = []
    plain = wf.boosted_walk_forward
    monkeypatch.setattr(wf, "boosted_walk_forward", lambda t, f, w, *a: fitted.extend(w) or plain(t, f, w, *a))
    wf.run_boosted(panel, str(tmp_path), columns=tb.FEATURES, settings=settings, **YEARS)
    assert fitted == [(2001, 1999)]


def test_nothing_is_left_in_the_shared_folder(spark, panel, tmp_path):
    before = set(os.listdir(storage.shared_folder(spark).removeprefix("file:")))
    wf.run_linear(panel, str(tmp_path), **YEARS)
    assert set(os.listdir(storage.shared_folder(spark).removeprefix("file:"))) == before


def test_same_month_run_keeps_modes_apart(spark, panel, tmp_path):
    summary = wf.run_linear(panel, str(tmp_path), mode="same_month", **YEARS)
    assert summary.first()["target_mode"] == "same_month"
    assert os.path.isdir(f"{tmp_path}/predictions_OLS3_Huber_same_month.parquet")


def test_a_changed_panel_is_fitted_anew_in_the_same_folder(spark, panel, tmp_path, monkeypatch):
    settings = BoostSettings(trees=3, rate=0.5, min_child_weight=20)
    run = lambda p: wf.run_boosted(p, str(tmp_path), columns=tb.FEATURES, settings=settings, **YEARS).first()
    fitted = []
    plain = wf.boosted_walk_forward
    monkeypatch.setattr(wf, "boosted_walk_forward", lambda t, f, w, *a: fitted.extend(w) or plain(t, f, w, *a))
    first = run(panel)
    assert run(panel) == first and fitted == [(2000, 1998), (2001, 1999)]
    turned = panel.withColumn("ret_excess", panel["ret_excess"] * -3)
    other = run(turned)
    assert len(fitted) == 4 and other["r2_all_pct"] != first["r2_all_pct"]
    path = f"{tmp_path}/predictions_GBRT_94_huber_next_month.parquet"
    name, = [d for d in os.listdir(path) if d.startswith("run=")]
    line = spark.read.parquet(f"{path}/{name}/2000/_manifest/part-*").first()
    assert line["train_end"] == 1998 and "next_month" in line["settings"] and name == f"run={line['run']}"
    os.remove(f"{path}/{name}/2001/_manifest/_SUCCESS")  # a run killed before its commit
    assert run(turned) == other and fitted[4:] == [(2001, 1999)]
