"""Raw CSV in, parquet in and out, summary CSV out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cleaning import blank_tokens, lenient_double
from panelloom.sources.storage import delete

# Columns that hold returns mixed with letter codes.
RETURN_COLUMNS = ["RET", "DLRET"]


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as a string: no inference pass and no value lost to a wrong guess.

    The header alone is read first, so that the scan itself has a fixed schema.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_csv_clean(spark: SparkSession, path: str) -> DataFrame:
    """Strings with missing-value tokens turned into NULL, all columns in one projection."""
    raw = read_csv_strings(spark, path)
    return raw.select([blank_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def numbers_where_present(columns: list[str] = RETURN_COLUMNS) -> Callable[[DataFrame], DataFrame]:
    """Turns those of `columns` that a table has into doubles and leaves the rest as cleaned text."""
    def convert(raw: DataFrame) -> DataFrame:
        return raw.select([
            (lenient_double if c in columns else blank_tokens)(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return convert


def csv_to_parquet(spark: SparkSession, sources: Mapping[str, str], folder: str,
                   cleaners: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
                   writers: Mapping[str, Callable[[DataFrame, str], str]] | None = None) -> dict[str, str]:
    """Convert each named CSV once; an output that was written to its end is left alone.

    A source without a cleaner of its own keeps its columns as text, return columns as numbers; one without a writer
    becomes a plain parquet folder. An output without
    the mark of a finished write, left by a killed job, is written again.
    """
    written = {}
    for name, path in sources.items():
        written[name] = f"{folder.rstrip('/')}/{name}.parquet"
        if not write_finished(spark, written[name]):
            typed = (cleaners or {}).get(name, numbers_where_present())(read_csv_strings(spark, path))
            (writers or {}).get(name, write_parquet)(typed, written[name])
    return written


def write_finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds the `_SUCCESS` mark that Spark leaves when all tasks have been committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return path


def write_by_year(df: DataFrame, path: str, year: str = "target_year") -> str:
    """One folder per year; a rerun replaces only the years it holds."""
    (df.hint("rebalance", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("compression", "zstd").partitionBy(year).parquet(path))
    return path


def write_summary_csv(df: DataFrame, path: str) -> str:
    """A report of a few rows as one CSV file with a header, at `path` itself.

    Spark writes its one part into a folder beside it; moving that part is the commit. Until then `path` holds the report of
    the last run or nothing, so a killed job leaves no half-written report.
    """
    spark = df.sparkSession
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        df.coalesce(1).write.option("header", True).csv(side)
        paths = spark._jvm.org.apache.hadoop.fs
        target = paths.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        part, = [f.getPath() for f in files.listStatus(paths.Path(side)) if f.getPath().getName().startswith("part-")]
        files.delete(target, True)
        if not files.rename(part, target):
            raise OSError(f"could not move the report to {path}")
        # a local folder's checksum came along; it would lie among the reports as a hidden file
        files.delete(paths.Path(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        delete(spark, side)
    return path
