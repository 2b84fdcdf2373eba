"""Raw sources to the master panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.constants import CHARACTERISTICS, MACROS, PANEL_FIRST_YEAR, PANEL_LAST_YEAR
from panelloom.functions import cleaning as clean
from panelloom.functions import finance
from panelloom.operators.evaluate import panel_coverage, panel_qa
from panelloom.operators.joins import join_small
from panelloom.operators.timeseries import lag_by_row, require_unique
from panelloom.sources.colocated import joins_by_entity, read_colocated, write_colocated
from panelloom.sources.tables import csv_to_parquet, write_summary_csv


def clean_characteristics(raw: DataFrame, columns: list[str] = CHARACTERISTICS) -> DataFrame:
    """permno, month, month_id, sic2 and the characteristics as doubles."""
    month = clean.date_from_compact(clean.blank_tokens(F.col("DATE")))
    return raw.select(
        clean.strict_long(F.col("permno")).alias("permno"), month.alias("month"),
        clean.month_index(month).alias("month_id"), clean.lenient_long(F.col("sic2")).alias("sic2"),
        *[clean.lenient_double(F.col(c)).alias(c) for c in columns])


def with_key(df: DataFrame) -> DataFrame:
    """Rows with an entity and a month; others match nothing later on, and together they would all go to one task."""
    return df.filter(F.col("permno").isNotNull() & F.col("month_id").isNotNull())


def clean_securities(raw: DataFrame) -> DataFrame:
    """Returns, prices and codes per security and month, with the cap of the previous row."""
    return add_security_measures(typed_securities(raw))


def typed_securities(raw: DataFrame) -> DataFrame:
    number, code = clean.lenient_double, clean.lenient_long
    return raw.select(
        clean.strict_long(F.col("PERMNO")).alias("permno"),
        clean.month_index(clean.date_from_slashes(F.col("date"))).alias("month_id"),
        number(F.col("RET")).alias("ret"), number(F.col("DLRET")).alias("dlret"),
        number(F.col("PRC")).alias("prc"), number(F.col("SHROUT")).alias("shrout"),
        number(F.col("VOL")).alias("vol"), code(F.col("SHRCD")).alias("shrcd"),
        code(F.col("EXCHCD")).alias("exchcd"), code(F.col("SICCD")).alias("siccd_crsp"))


def add_security_measures(typed: DataFrame) -> DataFrame:
    """Adjusted return, price, cap and lagged cap from typed security rows."""
    measured = with_key(typed).select(
        "*", finance.delisting_adjusted(F.col("ret"), F.col("dlret")).alias("ret_adj"),
        finance.absolute_price(F.col("prc")).alias("price_abs"),
        finance.market_cap(F.col("prc"), F.col("shrout")).alias("mktcap"))
    return measured.select(
        "permno", "month_id", "ret", "dlret", "ret_adj", "price_abs", "mktcap",
        lag_by_row("mktcap").alias("mktcap_lag"), "vol", "shrcd", "exchcd", "siccd_crsp")


def clean_risk_free(raw: DataFrame) -> DataFrame:
    month = clean.date_from_slashes(F.col("dateff"))
    return raw.select(clean.month_index(month).alias("month_id"), clean.strict_double(F.col("rf")).alias("rf"))


def clean_macro(raw: DataFrame) -> DataFrame:
    """month_id and the eight macro states as macro_<name>."""
    number = {c: clean.lenient_double(F.col(f"`{c}`"))
              for c in ["Index", "D12", "E12", "b/m", "ntis", "tbl", "lty", "AAA", "BAA", "svar"]}
    states = finance.macro_states(
        index=number["Index"], d12=number["D12"], e12=number["E12"], book_to_market=number["b/m"],
        ntis=number["ntis"], tbl=number["tbl"], lty=number["lty"], aaa=number["AAA"],
        baa=number["BAA"], svar=number["svar"])
    month_id = clean.month_index_from_yyyymm(clean.strict_long(F.col("yyyymm")))
    return raw.select(month_id.alias("month_id"), *[states[m].alias(f"macro_{m}") for m in MACROS])


def master_panel(characteristics: DataFrame, securities: DataFrame, risk_free: DataFrame, macro: DataFrame,
                 first_year: int = PANEL_FIRST_YEAR, last_year: int = PANEL_LAST_YEAR) -> DataFrame:
    """Entity-months with both sources, their series values and the excess return.

    The year range is stated on `month_id`, which reaches the scans of both large sides; the two
    series are small and joined last.
    """
    in_range = F.col("month_id").between(first_year * 12 + 1, last_year * 12 + 12)
    joined = characteristics.filter(in_range).join(securities, ["permno", "month_id"], "inner")
    joined = join_small(joined, risk_free, ["month_id"], "left")
    joined = join_small(joined, macro, ["month_id"], "left")
    ordered = (characteristics.columns + [c for c in securities.columns if c not in ("permno", "month_id")]
               + [c for c in risk_free.columns + macro.columns if c != "month_id"])
    return joined.select(*ordered, finance.excess_return(F.col("ret_adj"), F.col("rf")).alias("ret_excess"))


def write_master_panel(characteristics: DataFrame, securities: DataFrame, risk_free: DataFrame, macro: DataFrame, path: str,
                       first_year: int = PANEL_FIRST_YEAR, last_year: int = PANEL_LAST_YEAR) -> str:
    """The panel of two co-located sources, joined bucket by bucket and stored as they lie."""
    with joins_by_entity(characteristics.sparkSession):
        return write_colocated(master_panel(characteristics, securities, risk_free, macro, first_year, last_year), path, in_place=True)


def build_master_panel(spark: SparkSession, csv_sources: dict[str, str], folder: str) -> str:
    """CSV files (author, wrds, ff3mom, goyal; others are only converted) to a stored master panel and its QA.

    Each source is read as text once and kept typed, so the joins start from columns that filters
    and pruning reach. The two large ones and the panel lie in buckets of the entity (`read_colocated`): each of the two is
    shuffled once, as it is stored, and the lag, the check of its keys, the join and next month's look-ahead move nothing. Sources stored by an earlier run are left alone. A security with two rows in one month is an
    error: its previous row would depend on their order. Beside the panel go `panel_qa.csv` and `panel_coverage.csv`.
    Returns the panel's path.
    """
    cleaners = {"author": lambda raw: with_key(clean_characteristics(raw)), "wrds": lambda raw: with_key(typed_securities(raw)),
                "ff3mom": clean_risk_free, "goyal": clean_macro}
    stored = csv_to_parquet(spark, csv_sources, folder, cleaners, {"author": write_colocated, "wrds": write_colocated})
    author, wrds, ff3mom, goyal = (read_colocated(spark, stored[name]) for name in cleaners)
    require_unique(wrds, ["permno", "month_id"])
    folder = folder.rstrip("/")
    path = write_master_panel(author, add_security_measures(wrds), ff3mom, goyal, f"{folder}/master_panel.parquet")
    panel = read_colocated(spark, path)
    write_summary_csv(panel_qa(panel), f"{folder}/panel_qa.csv")
    write_summary_csv(panel_coverage(panel), f"{folder}/panel_coverage.csv")
    return path
