import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelloom.functions import cleaning as clean
from panelloom.functions import finance


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(expression(F.col("v"))).collect()]


def test_tokens_and_trim(spark):
    got = apply(spark, ["", " NA", "NaN", "NULL", "null", ".", " 0.2 ", "x", None], clean.blank_tokens)
    assert got == [None] * 6 + ["0.2", "x", None]


def test_lenient_double(spark):
    values = ["1.5", " 0.2 ", "-3", "+.5", "1.", "2e3", "1.5d", "nan", "inf", "C", "", ".", "1,5", None]
    assert apply(spark, values, clean.lenient_double) == [1.5, 0.2, -3.0, 0.5, 1.0, 2000.0] + [None] * 8


def test_lenient_long(spark):
    values = ["12", " 12 ", "12.0", "12.", "-7", "12.5", "Z", "", "9" * 30, None]
    assert apply(spark, values, clean.lenient_long) == [12, 12, 12, 12, -7] + [None] * 5


def test_strict_casts_fail_on_junk(spark):
    assert apply(spark, ["7", "NA"], clean.strict_long) == [7, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply(spark, ["x7"], clean.strict_double)


def test_dates_and_month_numbers(spark):
    assert apply(spark, ["1/2/2000", "31/12/2000", "NA"], clean.date_from_slashes) == [
        datetime.date(2000, 2, 1), datetime.date(2000, 12, 31), None]
    assert apply(spark, [20000229], clean.date_from_compact, "bigint") == [datetime.date(2000, 2, 29)]
    assert apply(spark, [datetime.date(1999, 12, 31), datetime.date(2000, 1, 1)], clean.month_index, "date") == [
        1999 * 12 + 12, 2000 * 12 + 1]
    assert apply(spark, [199912, 200001], clean.month_index_from_yyyymm, "bigint") == [
        1999 * 12 + 12, 2000 * 12 + 1]


def test_finite(spark):
    assert apply(spark, [1.0, math.nan, math.inf, -math.inf, None], clean.is_finite, "double") == [
        True, False, False, False, False]


def test_delisting_adjusted_return(spark):
    rows = [(0.1, -0.5), (None, -0.5), (0.1, None), (None, None)]
    df = spark.createDataFrame(rows, "ret double, dlret double")
    got = [r[0] for r in df.select(finance.delisting_adjusted(F.col("ret"), F.col("dlret"))).collect()]
    assert got[0] == pytest.approx(1.1 * 0.5 - 1) and got[1:] == [-0.5, 0.1, None]


def test_log_ratio_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (1.0, 0.0), (-1.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(finance.log_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(math.log(0.5)), None, None, None]


def test_huber_pieces(spark):
    xi = F.lit(0.5)
    df = column(spark, [0.0, 0.5, -2.0], "double")
    rows = df.select(finance.huber_loss(F.col("v"), xi), finance.huber_psi(F.col("v"), xi),
                     finance.huber_weight(F.col("v"), xi)).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 1.0), (0.25, 0.5, 1.0), (1.75, -0.5, 0.25)]
