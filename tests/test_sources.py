import glob
import os

import pytest
from pyspark.sql import functions as F

from panelloom.constants import CHARACTERISTICS, LINEAR_CHARACTERISTICS, MACROS
from panelloom.plans.panel import build_master_panel, clean_securities
from panelloom.sources import schema, storage, tables


def write(path, text):
    with open(path, "w") as out:
        out.write(text)
    return str(path)


def test_every_csv_column_is_text_and_tokens_are_null(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,b/m,code\n1,0.5,Z\n2, NA ,.\n")
    df = tables.read_csv_clean(spark, path)
    assert {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [("1", "0.5", "Z"), ("2", None, None)]


def test_conversion_leaves_existing_outputs_alone(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,RET\n1, 0.5 \n2,C\n")
    out = tables.csv_to_parquet(spark, {"a": path}, str(tmp_path / "interim"))["a"]
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("1", 0.5), ("2", None)]
    assert all("zstd" in f for f in glob.glob(out + "/part-*"))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(out + "/*")}
    tables.csv_to_parquet(spark, {"a": write(tmp_path / "a.csv", "id,RET\n9,9\n")}, str(tmp_path / "interim"))
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(out + "/*")} == before


def test_a_rerun_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "preds")
    rows = spark.createDataFrame([(1, 2000, 0.1), (1, 2001, 0.2)], "permno int, target_year int, prediction double")
    tables.write_by_year(rows, path)
    tables.write_by_year(rows.filter("target_year = 2001").withColumn("prediction", F.lit(9.0)), path)
    got = {r["target_year"]: r["prediction"] for r in spark.read.parquet(path).collect()}
    assert got == {2000: 0.1, 2001: 9.0}


def test_summary_is_one_csv_file(spark, tmp_path):
    """A plain file, replaced by the next report and by nothing else; an older folder in its place goes."""
    path = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").mkdir()
    for n in (3, 2, 0):
        assert tables.write_summary_csv(spark.range(n), path) == path
        with open(path) as f:
            assert f.read().split() == ["id", *map(str, range(n))]
        assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["s.csv"]
        assert spark.read.option("header", True).csv(path).count() == n
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.write_summary_csv(spark.range(3).select(F.expr("1 / (id - id)").alias("id")), path)
    assert open(path).read().split() == ["id"]
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["s.csv"]


def test_stored_tables_prune_partitions_and_go_to_the_shared_folder(spark):
    df = storage.materialize(spark.range(100).withColumn("target_year", F.col("id") % 5), "t", ["target_year"])
    plan = df.filter("target_year = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target_year" in plan
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="Missing characteristics: \\['c'\\]"):
        schema.require_columns(["a", "b"], ["a", "c"], "characteristics")


def test_macro_resolution():
    usual = [f"macro_{m}" for m in MACROS]
    assert schema.resolve_macro_columns(usual + MACROS)["dp"] == "macro_dp"
    own = {"dp": ["dividend_price", "dp_y"], "ep": "earnings"}
    assert schema.resolve_macro_columns([*usual, "dp_y", "earnings"], names=own)["dp"] == "dp_y"
    assert schema.resolve_macro_columns([*usual, "dp_y", "earnings"], names=own)["ep"] == "earnings"
    with pytest.raises(ValueError, match=r"\['ep', 'bm'\].*bm"):
        schema.resolve_macro_columns(["ep", "bm", *[c for c in usual if c not in ("macro_ep", "macro_bm")]])


def test_an_interrupted_conversion_is_written_again(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,RET\n1,0.5\n")
    (tmp_path / "s.parquet" / "_temporary").mkdir(parents=True)
    stored = tables.csv_to_parquet(spark, {"s": str(tmp_path / "s.csv")}, str(tmp_path))["s"]
    assert [tuple(r) for r in spark.read.parquet(stored).collect()] == [("1", 0.5)]
    (tmp_path / "s.csv").write_text("a,RET\n2,0.5\n")
    tables.csv_to_parquet(spark, {"s": str(tmp_path / "s.csv")}, str(tmp_path))
    assert spark.read.parquet(stored).first()["a"] == "1"


def test_constants():
    assert len(CHARACTERISTICS) == len(set(CHARACTERISTICS)) == 94
    assert set(LINEAR_CHARACTERISTICS) <= set(CHARACTERISTICS)


def test_master_panel_from_csv_files(spark, tmp_path):
    chars = ",".join(CHARACTERISTICS)
    values = ",".join(["1.5"] + ["NA"] * 92 + ["x"])
    author = write(tmp_path / "author.csv", f"permno,DATE,sic2,{chars}\n"
                   + "".join(f"7,{d},{s},{values}\n" for d, s in [(20000131, "35"), (20000229, "35.0"), (20000430, "Z"),
                                                                 (20170131, "35")]))
    head = "PERMNO,date,RET,DLRET,DLPRC,PRC,VOL,SHROUT,SHRCD,EXCHCD,SICCD\n"
    wrds = write(tmp_path / "wrds.csv", head + "7,31/1/2000,C,,,-10,5,100,10,1,3500\n"
                 "7,29/02/2000,0.10,,,11,5,100,10,Z,3500\n7,30/04/2000,0.2,-0.5,,12,.,100,10,1,Z\n"
                 "7,31/01/2017,0.2,,,12,.,100,10,1,Z\n")
    ff3 = write(tmp_path / "ff3.csv", "dateff,rf\n31/1/2000,0.004\n29/2/2000,0.005\n")
    goyal = write(tmp_path / "goyal.csv", "yyyymm,Index,D12,E12,b/m,tbl,AAA,BAA,lty,ntis,svar\n"
                  "200001,100,2,4,0.3,0.05,0.06,0.08,0.07,NaN,0.01\n")
    path = build_master_panel(spark, {"author": author, "wrds": wrds, "ff3mom": ff3, "goyal": goyal,
                                      "ff5mom": ff3}, str(tmp_path / "out"))
    panel = spark.read.parquet(path)
    assert len(panel.columns) == 118
    rows = {r["month_id"]: r for r in panel.collect()}
    jan, feb, apr = (rows[2000 * 12 + m] for m in (1, 2, 4))
    assert len(rows) == 3  # 2017 is outside the sample
    assert jan["price_abs"] == 10 and jan["mktcap"] == 1000 and jan["mktcap_lag"] is None
    assert jan["ret_adj"] is None and jan["ret_excess"] is None and feb["ret_excess"] == pytest.approx(0.095)
    assert (jan["sic2"], feb["sic2"], apr["sic2"]) == (35, 35, None)
    assert feb["exchcd"] is None and apr["siccd_crsp"] is None and apr["vol"] is None
    assert apr["ret_adj"] == pytest.approx(1.2 * 0.5 - 1) and apr["rf"] is None and apr["ret_excess"] is None
    assert apr["mktcap_lag"] == 1100  # the previous row, two months back
    assert jan["macro_dp"] == pytest.approx(-3.912023005) and jan["macro_tms"] == pytest.approx(0.02)
    assert jan["macro_dfy"] == pytest.approx(0.02) and jan["macro_ntis"] is None and feb["macro_bm"] is None
    assert jan["absacc"] == 1.5 and jan["zerotrade"] is None


def test_security_names_do_not_clash(spark):
    raw = spark.createDataFrame([("1", "1/1/2000", "0.1", None, "5", "6", "7", "10", "1", "2")],
                                "PERMNO string, date string, RET string, DLRET string, PRC string, SHROUT string, "
                                "VOL string, SHRCD string, EXCHCD string, SICCD string")
    assert clean_securities(raw).first()["ret"] == 0.1
