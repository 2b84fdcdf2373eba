import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.constants import CHARACTERISTICS, MACROS
from panelloom.operators import features as ft
from panelloom.operators.timeseries import duplicate_keys, require_unique
from panelloom.plans.prepare import prepare_panel, target_panel
from panelloom.plans.walkforward import split, walk_forward_windows

PANEL = ("permno bigint, month_id bigint, month date, ret_excess double, mktcap double, mktcap_lag double, "
         "bm double, sic2 bigint")


def day(month_id):
    return datetime.date((month_id - 1) // 12, (month_id - 1) % 12 + 1, 1)


def panel(spark, rows):
    """rows: (permno, month_id, ret_excess, bm)"""
    return spark.createDataFrame(
        [(p, m, day(m), r, 100.0 * p, 90.0 * p, b, p % 3) for p, m, r, b in rows], PANEL)


def test_target_is_calendar_exact_and_drops_the_last_month(spark):
    df = panel(spark, [(1, 100, 0.1, 1.0), (1, 101, 0.2, 1.0), (1, 103, 0.3, 1.0), (2, 100, 0.4, 1.0)])
    got = {(r["permno"], r["month_id"]): r for r in ft.next_month_target(df).collect()}
    assert got[1, 100]["y"] == 0.2 and got[1, 100]["target_month_id"] == 101
    assert got[1, 100]["target_month"] == day(101) and got[1, 100]["size_for_ranking"] == 100.0
    assert got[1, 101]["y"] is None and got[1, 103]["y"] is None and got[2, 100]["target_year"] is None
    kept = ft.target_sample(ft.next_month_target(df), 0, 10_000).collect()
    assert [(r["permno"], r["month_id"]) for r in kept] == [(1, 100)]


def test_target_equals_the_shifted_self_join(spark):
    rng = np.random.default_rng(1)
    rows = [(p, m, float(rng.normal()), 1.0) for p in range(20) for m in range(200, 260) if rng.random() < 0.7]
    df = panel(spark, rows)
    later = df.select("permno", (F.col("month_id") - 1).alias("month_id"), F.col("ret_excess").alias("y"))
    want = df.join(later, ["permno", "month_id"], "left").select("permno", "month_id", "y")
    got = ft.next_month_target(df).select("permno", "month_id", "y")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_repeated_months_fail_instead_of_mixing(spark):
    df = panel(spark, [(1, 100, 0.1, 1.0), (1, 100, 0.2, 1.0), (1, 101, 0.3, 1.0)])
    with pytest.raises(Exception, match="repeated"):
        ft.target_sample(ft.next_month_target(df), 0, 10_000).collect()
    assert [r["n_rows"] for r in duplicate_keys(df, ["permno", "month_id"]).collect()] == [2]
    with pytest.raises(ValueError, match="not unique"):
        require_unique(df, ["permno", "month_id"])


def test_same_month_target_and_unknown_mode(spark):
    df = panel(spark, [(1, 100, 0.1, 1.0)])
    row = ft.attach_target(df, "same_month").first()
    assert (row["y"], row["target_month_id"], row["size_for_ranking"]) == (0.1, 100, 90.0)
    with pytest.raises(ValueError, match="mode"):
        ft.attach_target(df, "next_year")


def ranks(spark, rows, precision="double"):
    filled = ft.fill_with_median(panel(spark, rows), ["bm"], precision=precision)
    got = ft.rank_transform(filled, ["bm"], precision=precision).collect()
    return {(r["permno"], r["month_id"]): (r["bm_filled"], r["bm_rank"]) for r in got}


def test_fill_and_rank_edge_cases(spark):
    got = ranks(spark, [(1, 100, 0.0, 5.0),                                             # alone
                        (1, 101, 0.0, None), (2, 101, 0.0, None),                       # nothing known
                        (1, 102, 0.0, 1.0), (2, 102, 0.0, 3.0), (3, 102, 0.0, None),    # median 2
                        (1, 103, 0.0, 2.0), (2, 103, 0.0, 2.0), (3, 103, 0.0, None), (4, 103, 0.0, 9.0)])
    assert got[1, 100] == (5.0, 0.0)
    assert got[1, 101] == got[2, 101] == (0.0, 0.0)
    assert [got[p, 102] for p in (1, 2, 3)] == [(1.0, -1.0), (3.0, 1.0), (2.0, 0.0)]
    assert [got[p, 103][1] for p in (1, 2, 3)] == pytest.approx([-1 / 3] * 3) and got[4, 103][1] == 1.0


def test_single_precision_makes_ties(spark):
    rows = [(1, 100, 0.0, 1.0), (2, 100, 0.0, 1.0 + 1e-12), (3, 100, 0.0, 2.0)]
    assert [ranks(spark, rows)[p, 100][1] for p in (1, 2, 3)] == [-1.0, 0.0, 1.0]
    assert [ranks(spark, rows, "float")[p, 100][1] for p in (1, 2, 3)] == [-0.5, -0.5, 1.0]


@pytest.mark.parametrize("limit", [4_000_000, 15])
def test_ranks_lie_in_range_and_sum_to_zero(spark, limit):
    rng = np.random.default_rng(2)
    rows = [(p, m, 0.0, None if rng.random() < 0.2 else float(rng.integers(0, 12)))
            for m in range(100, 104) for p in range(40)]
    filled = ft.fill_with_median(panel(spark, rows), ["bm"], values_per_task=limit)
    got = ft.rank_transform(filled, ["bm"], values_per_task=limit).groupBy("month_id").agg(
        F.min("bm_rank"), F.max("bm_rank"), F.sum("bm_rank"), F.count("bm_rank")).collect()
    for _, low, high, total, n in got:
        assert -1 <= low and high <= 1 and abs(total) < 1e-9 and n == 40


def macro_panel(spark):
    rows = [(p, m, 0.1, 1.0) for m in range(100, 104) for p in range(m - 98)]
    value = F.when(F.col("month_id") != 102, F.col("month_id") * 1.0)
    return panel(spark, rows).select("*", *[value.alias(f"macro_{m}") for m in MACROS])


def test_macro_fill_looks_back_only_unless_asked(spark):
    df, names = macro_panel(spark), {m: f"macro_{m}" for m in MACROS}
    back = {r["month_id"]: r["macro_dp"] for r in ft.fill_macros_expanding(df, names).collect()}
    assert back == {100: 100.0, 101: 101.0, 102: 100.5, 103: 103.0}
    whole = {r["month_id"]: r["macro_dp"] for r in ft.fill_macros_global(df, names).collect()}
    assert whole[102] == 102.0  # ten rows, 2 x 100, 3 x 101, 5 x 103: the middle two are 101 and 103


def test_interactions_and_their_count(spark):
    names = ft.interaction_names(CHARACTERISTICS)
    assert len(names) == len(set(names)) == 94 * 9 and names[:2] == ["absacc_rank", "absacc_x_dp"]
    df = macro_panel(spark).withColumn("bm_rank", F.lit(0.5))
    got = ft.add_interactions(df, ["bm"], ["dp"]).filter("month_id = 101").first()
    assert got["bm_x_dp"] == 50.5


def test_industry_dummies(spark):
    df = panel(spark, [(1, 100, 0.1, 1.0), (2, 100, 0.1, 1.0), (3, 100, 0.1, 1.0)])
    df = df.withColumn("sic2", F.when(F.col("permno") != 3, F.col("sic2")))
    codes = ft.industry_codes(df)
    assert codes == [1, 2]
    got = ft.add_industry_dummies(df, codes).orderBy("permno").select("sic_1", "sic_2").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    with pytest.raises(ValueError, match="distinct"):
        ft.industry_codes(df, max_codes=1)


def test_prepared_panel_ranks_only_rows_with_a_target(spark):
    df = panel(spark, [(1, 100, 0.0, 1.0), (2, 100, 0.0, 2.0), (3, 100, 0.0, 3.0), (1, 101, 0.1, 1.0), (3, 101, 0.2, 2.0)])
    table, names = prepare_panel(df, ["bm"], first=0, last=10_000)
    assert names == ["bm_rank"]
    assert {r["permno"]: r["bm_rank"] for r in table.collect()} == {1: -1.0, 3: 1.0}
    with pytest.raises(ValueError, match="Missing characteristic columns"):
        prepare_panel(df, ["bm", "nope"])
    with pytest.raises(ValueError, match="No column found"):
        prepare_panel(df, ["bm"], macros=MACROS)


@pytest.mark.parametrize("mode", ["same_month", "next_month"])
def test_a_repeated_month_is_an_error(spark, mode):
    df = panel(spark, [(1, 100, 0.1, 1.0), (1, 100, 0.2, 2.0), (2, 100, 0.3, 3.0), (1, 101, 0.1, 1.0)])
    with pytest.raises(Exception, match="not unique|repeated"):
        prepare_panel(df, ["bm"], mode, first=0, last=10_000)


def test_prepared_panel_with_macros_over_all_routes(spark):
    first = None
    for limit in (4_000_000, 3):
        table, names = prepare_panel(macro_panel(spark), ["bm", "mktcap"], macros=MACROS, first=0, last=10_000,
                                     values_per_task=limit)
        rows = sorted(map(str, table.select("permno", "month_id", *names).collect()))
        assert len(names) == 18 and len(rows) == 9
        first = first or rows
        assert rows == first


def test_target_filter_reaches_the_look_ahead_and_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    panel(spark, [(1, 100, 0.1, 1.0)]).withColumn("other", F.lit(1)).write.parquet(path)
    plan = target_panel(spark.read.parquet(path), ["bm"], first=0, last=10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "other" not in plan


def test_windows_never_overlap(spark):
    windows = walk_forward_windows(range(1987, 2017))
    assert windows[0] == (1987, 1974) and len(windows) == 30 and all(t - e == 13 for t, e in windows)
    df = spark.range(1960, 2017).withColumnRenamed("id", "target_year")
    train, test = split(df, train_max_year=1974), split(df, test_year=1987)
    assert train.agg(F.max("target_year")).first()[0] == 1974 and test.count() == 1
