import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelloom.operators import features, orderstats
from panelloom.operators.features import ranked_features
from panelloom.operators.joins import join_small
from panelloom.sources.storage import materialize

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one month; half of that month's `b` is one value; some values missing."""
    rng = np.random.default_rng(3)
    n = 3000
    month = np.where(rng.random(n) < 0.35, 7, rng.integers(8, 28, n))
    b = np.round(rng.normal(size=n), 2)
    b[(month == 7) & (rng.random(n) < 0.5)] = 0.25
    pdf = pd.DataFrame({"permno": np.arange(n), "month_id": month, "a": rng.standard_cauchy(n), "b": b})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    return pdf, materialize(df, "skewed")


@pytest.mark.parametrize("limit", [10_000, 300, 20])
@pytest.mark.parametrize("method", ["linear", "disc", "nearest"])
def test_quantiles_on_every_route(skewed, limit, method):
    pdf, df = skewed
    probs = [0.01, 0.5, 0.999]
    def wanted(values):
        if method == "nearest":
            return [sorted(values)[int(np.floor(p * (len(values) - 1) + 0.5))] for p in probs]
        return list(np.quantile(values, probs, method="linear" if method == "linear" else "inverted_cdf"))

    for group in (["month_id"], []):
        got = orderstats.group_quantiles(df, group, NAMES, probs, method, limit).toPandas()
        keyed = pdf.groupby("month_id") if group else [(None, pdf)]
        for key, part in keyed:
            for i, c in enumerate(NAMES):
                row = got[(got.feature == i) & ((got.month_id == key) if group else True)].iloc[0]
                values = part[c].dropna()
                assert row["n"] == len(values)
                assert list(row["q"]) == pytest.approx(wanted(values), abs=1e-12)


@pytest.mark.parametrize("limit", [10_000, 700, 20])
def test_medians_on_every_route(skewed, limit):
    pdf, df = skewed
    got = orderstats.group_medians(df, ["month_id"], NAMES, "m_", limit).toPandas().set_index("month_id").sort_index()
    want = pdf.groupby("month_id")[NAMES].median().sort_index()
    assert np.allclose(got[["m_a", "m_b"]], want)
    assert list(got["group_rows"]) == list(pdf.groupby("month_id").size().sort_index())


@pytest.mark.parametrize("few", [8, 1])
@pytest.mark.parametrize("limit", [10_000, 700, 20])
def test_ranks_on_every_route(skewed, limit, few, monkeypatch):
    """Windows, Arrow groups, the long table and the cut long table agree with pandas."""
    pdf, df = skewed
    monkeypatch.setattr(orderstats, "FEW_COLUMNS", few)
    full = pdf.fillna({"a": 0.0})
    ranked = orderstats.average_ranks(df.fillna({"a": 0.0}), ["permno"], ["month_id"], NAMES, "_r", limit)
    got = ranked.toPandas().set_index("permno").sort_index()
    assert len(got) == len(full)
    want = full.groupby("month_id")[NAMES].rank("average")
    assert np.array_equal(got[["a_r", "b_r"]].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("few", [8, 1])
@pytest.mark.parametrize("limit", [10_000, 700, 20])
def test_null_has_no_rank_on_any_route(skewed, limit, few, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(orderstats, "FEW_COLUMNS", few)
    ranked = orderstats.average_ranks(df, ["permno"], ["month_id"], NAMES, "_r", limit)
    got = ranked.toPandas().set_index("permno").sort_index()
    want = pdf.groupby("month_id")[NAMES].rank("average")
    assert np.array_equal(got[["a_r", "b_r"]].to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("limit", [10_000, 700, 20])
def test_fill_and_rank_is_one_result(skewed, limit):
    pdf, df = skewed
    filled = pdf[NAMES].fillna(pdf.groupby("month_id")[NAMES].transform("median"))
    n = pdf.groupby("month_id")["b"].transform("size").to_numpy()[:, None]
    want = 2 * (filled.groupby(pdf["month_id"]).rank("average").to_numpy() - 1) / (n - 1) - 1
    got = ranked_features(df, NAMES, ["permno"], ["month_id"], values_per_task=limit).toPandas().set_index("permno").sort_index()
    assert np.allclose(got[["a_rank", "b_rank"]].to_numpy(), want, atol=1e-12)


def test_a_cut_month_is_spread_over_tasks(skewed):
    pdf, df = skewed
    hot = df.filter("month_id = 7")
    long = orderstats.to_long(hot, ["permno", "month_id"], ["b"])
    keys, buckets = ["month_id", "feature"], 12
    splits = orderstats._split_values(long, keys, buckets)
    sizes = orderstats._bucket_offsets(orderstats._with_bucket(long, splits, keys, buckets), keys).toPandas()
    assert sizes.bucket_rows.sum() == (pdf.month_id == 7).sum()
    between = sizes[sizes.bucket % 2 == 0].bucket_rows
    assert between.max() <= sizes.bucket_rows.sum() / buckets * 1.5
    assert sizes[sizes.bucket % 2 == 1].bucket_rows.max() > sizes.bucket_rows.sum() / 3  # the tied value


def test_ranks_over_ranges_take_two_shuffles_and_carry_ties_across_borders(spark, monkeypatch):
    """A value that fills several ranges, runs that end at borders, -0.0, infinities and NaN; text columns pass through."""
    rng = np.random.default_rng(8)
    n = 1200
    pdf = pd.DataFrame({"permno": rng.permutation(n), "month_id": np.where(rng.random(n) < 0.7, 7, 8),
                        "a": np.where(rng.random(n) < 0.6, 0.5, rng.integers(-3, 3, n)),
                        "b": rng.choice([0.0, -0.0, np.inf, -np.inf, 1.5], n), "name": [f"n{i}" for i in range(n)]})
    df = materialize(spark.createDataFrame(pdf).withColumn("b", F.when(F.col("permno") % 11 > 0, F.col("b")).otherwise(float("nan"))), "t")
    plans = []

    def watched(table, label, *rest):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return materialize(table, label, *rest)

    monkeypatch.setattr(orderstats, "materialize", watched)
    got = orderstats._ranks_by_range(df, ["permno"], ["month_id"], ["a", "b"], "_r", 50)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("Exchange") == plans[0].count("Exchange rangepartitioning") == 1
    assert plans[-1].count("Exchange") - plans[-1].count("BroadcastExchange") == 1
    got = got.toPandas().set_index("permno").sort_index()
    want = pdf.assign(b=pdf.b.where(pdf.permno % 11 > 0, np.float64(1e308) * 1.7)).set_index("permno").sort_index()
    want["b"] = want.b.replace(np.inf, 1e307)  # infinity stands below NaN
    ranks = want.groupby("month_id")[["a", "b"]].rank("average")
    assert list(got["name"]) == list(want["name"])
    assert np.array_equal(got[["a_r", "b_r"]].to_numpy(), ranks.to_numpy())


def test_ranges_are_no_more_than_tasks_of_a_shuffle(spark, skewed):
    assert orderstats._range_count(18_000_000, 16, 24) == 25
    assert orderstats._range_count(1_000_000_000, 16, 24) == 251
    assert orderstats._range_count(100, 60, 24) == 2
    _, df = skewed
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = []

    def watched(table, label, *rest):
        made = materialize(table, label, *rest)
        if label == "ranges":
            seen.append(made.select("_part").distinct().count())
        return made

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(orderstats, "materialize", watched)
        orderstats.average_ranks(df, ["permno"], ["month_id"], NAMES, "_r", 16)
    assert seen and max(seen) <= tasks + 1


def test_ranges_are_read_batch_by_batch(spark, skewed):
    """Runs of equal values go on over batches and over ranges."""
    pdf, df = skewed
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = orderstats.average_ranks(df, ["permno"], ["month_id"], NAMES, "_r", 60).toPandas().set_index("permno").sort_index()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = pdf.groupby("month_id")[NAMES].rank("average")
    assert np.array_equal(got[["a_r", "b_r"]].to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("precision", ["double", "float"])
def test_a_month_whose_columns_fit_is_ranked_in_blocks(skewed, precision, monkeypatch):
    pdf, df = skewed
    whole = ranked_features(df, NAMES, ["permno"], ["month_id"], precision).toPandas().set_index("permno").sort_index()

    def refused(*_):
        raise AssertionError("the long way")

    monkeypatch.setattr(features, "fill_with_median", refused)
    got = ranked_features(df, NAMES, ["permno"], ["month_id"], precision, values_per_task=1500)
    assert sorted(got.dtypes) == sorted(ranked_features(df, NAMES, ["permno"], ["month_id"], precision).dtypes)
    got = got.toPandas().set_index("permno").sort_index()
    assert np.array_equal(got[["a_rank", "b_rank"]].to_numpy(), whole[["a_rank", "b_rank"]].to_numpy())


@pytest.mark.parametrize("precision", ["double", "float"])
def test_a_column_too_long_is_ranked_as_arrays(spark, precision, monkeypatch):
    """No row for each value: distinct values by slice and range. Ties over slices, a middle between two ranges, columns without values, one row."""
    rng = np.random.default_rng(21)
    n = 1000
    pdf = pd.DataFrame({"permno": rng.permutation(n), "month_id": np.where(rng.random(n) < 0.6, 7, 8), "name": [f"n{i}" for i in range(n)],
                        "a": np.where(rng.random(n) < 0.5, 0.25, 1 + rng.integers(0, 400, n) * 1e-9), "b": rng.choice([0.0, -0.0, 2.0, 1e300, -1e300], n),
                        "c": np.where(rng.random(n) < 0.5, 1.0, 4.0), "d": np.full(n, np.nan)})
    pdf.loc[n] = [n, 9, "alone", 0.5, 1.0, 1.0, np.nan]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pdf).selectExpr("permno", "month_id", "name", *[f"if(isnan({c}) OR (permno + {i}) % 5 = 0, NULL, {c}) AS {c}" for i, c in enumerate(names)])
    df = materialize(df, "t")
    whole = ranked_features(df, names, ["permno"], ["month_id"], precision)
    types, whole = whole.dtypes, whole.toPandas().set_index("permno").sort_index()

    def refused(*_):
        raise AssertionError("a row for each value")

    monkeypatch.setattr(orderstats, "to_long", refused)
    monkeypatch.setattr(orderstats, "SLICE_VALUES", 600)
    labels = []
    monkeypatch.setattr(orderstats, "materialize", lambda t, label, *rest: labels.append((label, made := materialize(t, label, *rest))) or made)
    got = ranked_features(df, names, ["permno"], ["month_id"], precision, values_per_task=60)
    assert sorted(got.dtypes) == sorted(types)
    got = got.toPandas().set_index("permno").sort_index()
    assert list(got["name"]) == list(whole["name"])
    ranks = [f"{c}_rank" for c in names]
    assert np.array_equal(got[ranks].to_numpy(), whole[ranks].to_numpy())
    lines = dict(labels)["slices"].filter("_feature >= 0")
    assert lines.select("_slice").distinct().count() > 3 and lines.filter("_feature = 0").select("_range").distinct().count() > 1
    with pytest.raises(Exception, match="repeated key"):
        ranked_features(df.union(df), names, ["permno"], ["month_id"], precision, values_per_task=60).collect()


def test_nan_is_the_largest_value_of_a_column_too_long(spark):
    """Infinities and NaN, also as the middle: as the quantiles and ranks of the long table have them."""
    inf, nan = float("inf"), float("nan")
    rows = [(i, 7, a, b, c) for i, (a, b, c) in enumerate(zip([1.0, nan, None, 2.0, nan, nan], [-inf, -inf, inf, inf, None, None], [-inf, inf, nan, None, -inf, nan]))]
    df = materialize(spark.createDataFrame(rows, "permno int, month_id int, a double, b double, c double"), "t")
    got = ranked_features(df, ["a", "b", "c"], ["permno"], ["month_id"], values_per_task=2)
    filled = features.fill_with_median(df, ["a", "b", "c"], ["month_id"], values_per_task=2)
    want = features.rank_transform(filled, ["a", "b", "c"], ["permno"], ["month_id"], values_per_task=2)
    ranks = ["permno", "a_rank", "b_rank", "c_rank"]
    assert sorted(map(tuple, got.select(ranks).collect())) == sorted(map(tuple, want.select(ranks).collect()))


def test_groups_without_a_name_stay_with_the_small_ones(spark):
    df = materialize(spark.createDataFrame([(i, m, float(i)) for i, m in enumerate([7, 7, 7, None, None, None])], "permno int, month_id int, a double"), "t")
    small, large = orderstats.part_large_groups(df, ["month_id"], 2)
    assert small.count() == large.count() == 3
    small, large = orderstats.part_large_groups(df.filter("month_id = 7"), ["month_id"], 2)
    assert small.count() == 0 and large.count() == 3
    got = ranked_features(df, ["a"], ["permno"], ["month_id"], values_per_task=2).orderBy("permno").collect()
    assert [r["a_rank"] for r in got] == [-1, 0, 1, -1, 0, 1]


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_long_buckets_are_cut_again(skewed, method, monkeypatch):
    """The number of buckets of a round is bounded; positions are found all the same."""
    pdf, df = skewed
    want = orderstats.group_quantiles(df, [], NAMES, [0.01, 0.5, 0.999], method).orderBy("feature").collect()
    made = []
    split_values = orderstats._split_values
    monkeypatch.setattr(orderstats, "MOST_BUCKETS", 5)
    monkeypatch.setattr(orderstats, "_split_values", lambda rows, keys, buckets: made.append(buckets) or split_values(rows, keys, buckets))
    got = orderstats.group_quantiles(df, [], NAMES, [0.01, 0.5, 0.999], method, 20).orderBy("feature").collect()
    assert [(r["feature"], r["n"]) for r in got] == [(r["feature"], r["n"]) for r in want]
    assert np.allclose([r["q"] for r in got], [r["q"] for r in want], atol=1e-12)
    assert len(made) > 1 and max(made) <= 5


def test_a_repeated_key_is_refused_by_the_ranges(spark):
    df = materialize(spark.createDataFrame([(1, 7, 0.5), (1, 7, 0.25), (2, 7, 1.0)], "permno int, month_id int, a double"), "t")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        orderstats._ranks_by_range(df, ["permno"], ["month_id"], ["a"], "_r", 2).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(allow_infinity=True, allow_nan=False)), min_size=1))
def test_shared_ranks(values):
    got = orderstats.array_ranker()(np.array(values))
    assert np.array_equal(got, pd.Series(values).rank().to_numpy())
    assert got.sum() == len(values) * (len(values) + 1) / 2


@pytest.mark.parametrize("cells", [1_000_000, 1])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_small_join_and_its_salted_form(spark, cells, how):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 40)], "k bigint, v bigint")
    got = join_small(left, right, ["k"], how, max_cells=cells)
    want = left.join(right, ["k"], how)
    assert sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, want.select("id", "v").collect()))
