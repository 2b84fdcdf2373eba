"""Tables in buckets of the entity: what they hold, how they are read, and that plans over them move nothing."""

import pytest
from pyspark.sql import functions as F

from panelloom.operators.timeseries import attach_next_period, duplicate_keys
from panelloom.plans.panel import add_security_measures, clean_macro, clean_risk_free, master_panel
from panelloom.sources.colocated import joins_by_entity, read_colocated, write_colocated


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def rows_of(spark, n=400):
    k = F.col("id")
    return spark.range(n).select((k % 37).alias("permno"), (24000 + k / 37).cast("long").alias("month_id"), (k * 0.5).alias("a b"))


def test_round_trip_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "it's here")
    df = rows_of(spark).unionByName(spark.createDataFrame([(None, 24000, 1.0)], "permno long, month_id long, `a b` double"))
    for buckets, part in ((4, df), (7, df.filter("month_id < 24003")), (4, df.limit(0))):
        write_colocated(part, path, buckets=buckets)
        got = read_colocated(spark, path)
        assert got.dtypes == df.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, part.collect()))
        assert sorted(map(str, read_colocated(spark.newSession(), path).collect())) == sorted(map(str, part.collect()))
    write_colocated(df.drop("a b"), path, buckets=4)
    assert read_colocated(spark, path).columns == ["permno", "month_id"]


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    rows_of(spark).write.parquet(str(tmp_path / "plain"))
    assert read_colocated(spark, str(tmp_path / "plain")).count() == 400


def test_lag_keys_and_look_ahead_move_nothing(spark, tmp_path):
    df = rows_of(spark)
    got = read_colocated(spark, write_colocated(df, str(tmp_path / "t"), buckets=5))
    ahead = attach_next_period(got, {"y": "a b"})
    assert shuffles(ahead) == 0 and shuffles(attach_next_period(df, {"y": "a b"})) > 0
    assert shuffles(duplicate_keys(got, ["permno", "month_id"])) == 0
    assert sorted(map(str, ahead.collect())) == sorted(map(str, attach_next_period(df, {"y": "a b"}).collect()))


def test_the_panel_joins_where_the_sources_lie(spark, tmp_path, no_broadcast):
    k = F.col("id")
    keys = [(k % 37).alias("permno"), (24000 + k / 37).cast("long").alias("month_id")]
    author = spark.range(400).select(*keys, (k % 7 * 1.0).alias("bm"))
    wrds = spark.range(0, 400, 2).select(
        *keys, (k * 0.01).alias("ret"), F.lit(None).cast("double").alias("dlret"), (k * 1.0).alias("prc"), (k * 2.0).alias("shrout"),
        F.lit(1.0).alias("vol"), *[F.lit(1).cast("long").alias(c) for c in ("shrcd", "exchcd", "siccd_crsp")])
    free = clean_risk_free(spark.createDataFrame([("1/1/2000", "0.004")], "dateff string, rf string"))
    names = ["yyyymm", "Index", "D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "svar"]
    macro = clean_macro(spark.createDataFrame([["200001"] + ["0.5"] * 10], ", ".join(f"`{n}` string" for n in names)))
    plain = master_panel(author, add_security_measures(wrds), free, macro, 1990, 2010)
    author, wrds = (read_colocated(spark, write_colocated(df, str(tmp_path / n), buckets=6)) for n, df in (("a", author), ("w", wrds)))
    with joins_by_entity(spark):
        panel = master_panel(author, add_security_measures(wrds), free, macro, 1990, 2010)
        assert shuffles(panel) == 0
        path = write_colocated(panel, str(tmp_path / "panel"), buckets=6, in_place=True)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert len(list((tmp_path / "panel").glob("part-*"))) <= 6
    assert sorted(map(str, read_colocated(spark, path).collect())) == sorted(map(str, plain.collect()))
    assert shuffles(attach_next_period(read_colocated(spark, path), {"y": "ret_excess"})) == 0
