"""What makes the wide table of the workload and rounds its ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.sources.storage import materialize
from workload import queries, tables

WANTED = [("qty_1a", ("1a", "qty")), ("tax_1a", ("1a", "tax")), ("qty_2n", ("2n", "qty"))]


@pytest.mark.parametrize("batch", [10_000, 1, 7])
def test_sums_by_slot_are_conditional_sums(spark, batch):
    """Keys that go on over batches, missing keys, slots and measures, a slot that nobody asks for."""
    rng = np.random.default_rng(4)

    def some(values, n=400):
        return [None if rng.random() < 0.1 else v for v in rng.choice(np.array(values, object), n)]

    rows = list(zip(some([1, 2, 3]), some([24, 25, 26]), some(["1a", "2n", "3r"]), some([5, -7, 0]), some([1, 2 ** 60])))
    rows += [(9, 24, "3r", 1, 1), (10, 24, None, 1, 1), (11, 24, "1a", None, 1)]
    lines = spark.createDataFrame(rows, "permno bigint, month_id int, slot string, qty bigint, tax bigint").withColumn("tax", F.col("tax") % 1000)
    want = lines.groupBy("permno", "month_id").agg(*[F.sum(F.when(F.col("slot") == s, F.col(m))).alias(name) for name, (s, m) in WANTED])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = tables.sums_by_slot(lines, ["permno", "month_id"], "slot", WANTED)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert tables.sums_by_slot(lines.limit(0), ["permno", "month_id"], "slot", WANTED).count() == 0


def test_the_wide_table_shuffles_lines_not_sums(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(1, 1, "A", 2.0, 3.5, 0.05, 0.01), (1, 1, "a", 4.0, 1.0, 0.0, 0.02), (1, 8, "N", 9.0, 9.0, 0.0, 0.0), (2, None, "R", 1.0, 1.0, 0.0, 0.0)],
                                  "l_suppkey bigint, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    lines.withColumn("l_shipdate", F.lit("1995-03-09").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    plans = []
    monkeypatch.setattr(queries, "materialize", lambda t, label: plans.append(t._jdf.queryExecution().executedPlan().toString()) or materialize(t, label))
    rows = {r["permno"]: r for r in queries._wide(spark, str(tmp_path)).collect()}
    assert plans[0].count("Exchange") == 1 and "sum(" not in plans[0]
    assert len(rows) == 2 and [rows[1][c] for c in ("month_id", "qty_1a", "price_1a", "discount_1a", "tax_1a", "qty_1n")] == [1995 * 12 + 3, 6, 450, 5, 3, None]
    assert [rows[2][c] for c in queries.WIDE_NAMES] == [None] * len(queries.WIDE_NAMES)


def test_rounding_many_columns_is_rounding(spark):
    rng = np.random.default_rng(5)
    halves = [k / 2048 for k in range(-2049, 2050)] + [(k + 0.5) * 1e-9 for k in range(-40, 40)] + [np.nextafter((k + 0.5) * 1e-9, 1) for k in range(40)]
    odd = [None, 0.0, -0.0, -1e-12, 1e-12, float("inf"), -float("inf"), float("nan"), 1e300, -123456789.1234567895, 4503599.6273704955, 2.0 ** 53]
    rows = [(float(v) if v is not None else None, i) for i, v in enumerate([*halves, *odd, *rng.uniform(-1, 1, 3000).tolist(), *rng.normal(0, 1e6, 500).tolist()])]
    df = materialize(spark.createDataFrame(rows, "a double, i int"), "t")
    got = {r["i"]: repr(r["a"]) for r in queries._round_many(df, ["a"]).collect()}
    want = {r["i"]: repr(r["a"]) for r in queries._round_all(df, ["a"]).collect()}
    assert got == want
