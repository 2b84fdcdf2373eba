"""The driver's tables in the shape of the raw sources.

A supplier is the entity, the month of shipping or ordering the period. Sums are whole numbers, so
every engine gets the same ones in any order. Strings carry the codes and gaps of real files,
placed by rules on the number of lines `n`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cleaning import month_index
from panelloom.operators.timeseries import lag_by_row
from panelloom.plans.panel import (add_security_measures, clean_characteristics, clean_macro, clean_risk_free, clean_securities,
                                   master_panel, typed_securities, with_key, write_master_panel)
from panelloom.sources.colocated import read_colocated, write_colocated
from panelloom.sources.storage import materialize, scratch_path

FEATURES = ["mvel1", "bm", "mom12m"]
CHARACTERISTICS = FEATURES + ["turn", "retvol", "dolvol"]
FIRST_YEAR, LAST_YEAR = 1995, 2001
FIRST_TARGET, LAST_TARGET = 1995 * 12 + 3, 2001 * 12 + 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(value: Column) -> Column:
    return F.round(value * 100.0).cast("bigint")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and month: whole-number sums over its lines."""
    lines = table(spark, sf_dir, "lineitem")
    returned = (F.col("l_returnflag") == "R").cast("bigint")
    return lines.groupBy(
        F.col("l_suppkey").alias("permno"), month_index(F.col("l_shipdate")).alias("month_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hundredths(F.col("l_extendedprice"))).alias("cents"),
        F.max(hundredths(F.col("l_extendedprice"))).alias("top_cents"),
        F.min(hundredths(F.col("l_extendedprice"))).alias("low_cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(hundredths(F.col("l_discount"))).alias("discount"),
        F.sum(hundredths(F.col("l_tax"))).alias("tax"),
        F.sum(returned).alias("returned"))


def sums_by_slot(lines: DataFrame, keys: list[str], slot: str, wanted: list[tuple[str, tuple[str, str]]]) -> DataFrame:
    """One row for each value of the (whole-number) `keys`, and for each (name, (slot, measure)) in `wanted` the sum of the measure over the key's lines of that
    slot, NULL without a value.

    The lines are shuffled as they are and added up in the order of their keys: as many conditional sums in one aggregate would shuffle a
    wide row for nearly every line.
    """
    slots, measures = (list(dict.fromkeys(w[1][k] for w in wanted)) for k in (0, 1))
    named = F.array(*[F.lit(s) for s in slots])
    numbered = lines.select(*keys, (F.array_position(named, F.col(slot)) - 1).cast("int").alias("_slot"), *measures)
    schema = T.StructType([*[lines.schema[k] for k in keys], *[T.StructField(name, T.LongType()) for name, _ in wanted]])
    places = [(measures.index(m), slots.index(s)) for _, (s, m) in wanted]
    ordered = numbered.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_add_up(keys, measures, len(slots), places, schema.names), schema)


def _add_up(keys: list[str], measures: list[str], slots: int, places: list[tuple[int, int]], names: list[str]
            ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a partition sorted by `keys`, a batch at a time: each key's sums by measure and slot. The last key of a batch waits for the next one."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                there, value = batch.column(k).is_valid().to_numpy(zero_copy_only=False), batch.column(k).fill_null(0).to_numpy()
                new[1:] |= (value[1:] != value[:-1]) | (there[1:] != there[:-1])
            goes_on = waiting is not None and all(batch.column(k)[0].as_py() == waiting[0].column(k)[0].as_py() for k in keys)
            new[0] = not goes_on
            row = np.cumsum(new) - (0 if goes_on else 1) + (waiting is not None and not goes_on)
            heads = pa.Table.from_batches([batch]).select(keys).filter(pa.array(new))
            sums, seen = np.zeros((2, len(measures), row[-1] + 1, slots), np.int64)
            if waiting is not None:
                heads = pa.concat_tables([waiting[0], heads])
                sums[:, 0], seen[:, 0] = waiting[1:]
            slot = batch.column("_slot").fill_null(-1).to_numpy()
            for m, measure in enumerate(measures):
                column = batch.column(measure)
                some = column.is_valid().to_numpy(zero_copy_only=False) & (slot >= 0)
                np.add.at(sums[m], (row[some], slot[some]), column.fill_null(0).to_numpy()[some])
                seen[m][row[some], slot[some]] = 1
            waiting = heads.slice(len(heads) - 1), sums[:, -1].copy(), seen[:, -1].copy()
            if len(heads) > 1:
                yield done(heads.slice(0, len(heads) - 1), sums[:, :-1], seen[:, :-1])
        if waiting is not None:
            yield done(waiting[0], waiting[1][:, None], waiting[2][:, None])

    def done(heads: pa.Table, sums: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        made = [pa.array(np.ascontiguousarray(sums[m, :, s]), mask=seen[m, :, s] == 0) for m, s in places]
        return pa.RecordBatch.from_arrays([*[heads.column(k).combine_chunks() for k in keys], *made], names)

    return add_up


def _text(value: Column) -> Column:
    return value.cast("string")


def _unless(condition: Column, value: Column, code: str) -> Column:
    """The value as text, or a code where the condition holds."""
    return F.when(condition, F.lit(code)).otherwise(_text(value))


def _year(month_id: Column) -> Column:
    return F.floor((month_id - 1) / 12).cast("bigint")


def _month(month_id: Column) -> Column:
    return (month_id - 1) % 12 + 1


def _price() -> Column:
    return F.col("cents") / F.lit(100.0) / F.col("qty")


def raw_characteristics(cell: DataFrame, supplier: DataFrame) -> DataFrame:
    n, month_id = F.col("n"), F.col("month_id")
    joined = cell.join(supplier, cell["permno"] == supplier["s_suppkey"], "inner")
    return joined.select(
        _text(F.col("permno")).alias("permno"),
        _text((_year(month_id) * 100 + _month(month_id)) * 100 + 1).alias("DATE"),
        _unless(n % 19 == 0, F.col("s_nationkey"), "Z").alias("sic2"),
        _unless(n % 17 == 0, F.col("cents") / F.lit(1000000.0), "").alias("mvel1"),
        _unless(F.col("returned") == 0, F.col("discount") / n, "NA").alias("bm"),
        _unless(n % 7 == 0, F.col("qty") / n, ".").alias("mom12m"),
        F.concat(F.lit(" "), _unless(n % 5 == 0, F.col("tax") / n, "null")).alias("turn"),
        _unless(n == 1, (F.col("top_cents") - F.col("low_cents")) / F.lit(100.0), "NULL").alias("retvol"),
        _text(F.col("qty")).alias("dolvol"))


def raw_securities(cell: DataFrame) -> DataFrame:
    n, month_id = F.col("n"), F.col("month_id")
    priced = cell.select("*", _price().alias("prc"))
    priced = priced.select("*", (F.col("prc") / lag_by_row("prc") - 1.0).alias("ret"))
    return priced.select(
        _text(F.col("permno")).alias("PERMNO"),
        F.concat(F.lit("28/"), _text(_month(month_id)), F.lit("/"), _text(_year(month_id))).alias("date"),
        _unless(n % 13 == 0, F.coalesce(_text(F.col("ret")), F.lit("C")), "B").alias("RET"),
        _unless(n % 11 != 0, F.lit(0.01) * (n % 5), "S").alias("DLRET"),
        _text(F.when(n % 5 == 0, -F.col("prc")).otherwise(F.col("prc"))).alias("PRC"),
        _text(F.col("qty")).alias("SHROUT"),
        _unless(n % 23 == 0, F.col("qty"), "NaN").alias("VOL"),
        _unless(n % 6 == 0, 10 + n % 3, "Z").alias("SHRCD"),
        F.concat(_text(1 + n % 3), F.lit(".0")).alias("EXCHCD"),
        _unless(n % 9 == 0, 100 * (n % 40), "").alias("SICCD"))


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(month_index(F.col("o_orderdate")).alias("month_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths(F.col("o_totalprice"))).alias("cents"),
        F.count_if(status == "F").alias("n_f"), F.count_if(status == "O").alias("n_o"),
        F.count_if(status == "P").alias("n_p"))


def raw_risk_free(months: DataFrame) -> DataFrame:
    month_id = F.col("month_id")
    return months.filter(month_id % 12 != 5).select(
        F.concat(F.lit("1/"), _text(_month(month_id)), F.lit("/"), _text(_year(month_id))).alias("dateff"),
        _text(F.lit(0.001) * (F.col("n") % 5)).alias("rf"))


def raw_macro(months: DataFrame) -> DataFrame:
    n, month_id = F.col("n"), F.col("month_id")
    return months.filter(month_id % 10 != 3).select(
        _text(_year(month_id) * 100 + _month(month_id)).alias("yyyymm"),
        _text(F.col("cents") / F.lit(100.0) / n).alias("Index"),
        _text(F.col("n_f")).alias("D12"),
        _text(F.col("n_o")).alias("E12"),
        _text(F.col("n_p") / n).alias("b/m"),
        _text(F.lit(0.01) * (n % 9)).alias("tbl"),
        _text(F.lit(0.01) * (n % 5)).alias("AAA"),
        _text(F.lit(0.01) * (n % 8)).alias("BAA"),
        _text(F.lit(0.01) * (n % 7)).alias("lty"),
        _unless(n % 4 == 0, F.col("n_o") / n, "NA").alias("ntis"),
        _text(F.col("cents") % 1000 / F.lit(1000.0)).alias("svar"))


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines are scanned once; both entity sources derive from the stored cells."""
    return materialize(cells(spark, sf_dir), "cells")


def stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(order_months(spark, sf_dir), "months")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_securities(raw_securities(cells(spark, sf_dir)))


#: Where a benchmark keeps the panels it has built, by application and folder; None: every query builds its own.
kept: dict[tuple[str, str], DataFrame] | None = None


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master panel over the whole tables; text is parsed once, into stored typed sources."""
    if kept is None:
        return _built_panel(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in kept:
        kept[key] = materialize(_built_panel(spark, sf_dir), "panel")
    return kept[key]


def _built_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell, months = stored_cells(spark, sf_dir), stored_months(spark, sf_dir)
    author = clean_characteristics(raw_characteristics(cell, table(spark, sf_dir, "supplier")), CHARACTERISTICS)
    return master_panel(
        materialize(author, "characteristics"), materialize(clean_securities(raw_securities(cell)), "securities"),
        clean_risk_free(raw_risk_free(months)), clean_macro(raw_macro(months)), FIRST_YEAR, LAST_YEAR)


def colocated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same panel from sources that lie in buckets of the entity, stored in buckets itself."""
    cell, months = stored_cells(spark, sf_dir), stored_months(spark, sf_dir)
    author = with_key(clean_characteristics(raw_characteristics(cell, table(spark, sf_dir, "supplier")), CHARACTERISTICS))
    wrds = with_key(typed_securities(raw_securities(cell)))
    author, wrds = (read_colocated(spark, write_colocated(df, scratch_path(spark, "colocated"))) for df in (author, wrds))
    path = write_master_panel(author, add_security_measures(wrds), clean_risk_free(raw_risk_free(months)),
                              clean_macro(raw_macro(months)), scratch_path(spark, "colocated-panel"), FIRST_YEAR, LAST_YEAR)
    return read_colocated(spark, path)
