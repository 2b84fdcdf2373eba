"""Turning coded strings into typed values without ever failing a job on a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.constants import NULL_TOKENS

# Spark's own string casts also take Java suffixes ("1.5d"), "nan" and "infinity": match first.
# None of the missing-value tokens matches either pattern.
_DECIMAL = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
_WHOLE = r"^\s*([+-]?[0-9]+)([.]0*)?\s*$"


def blank_tokens(text: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    """Trimmed text, NULL when it is one of the missing-value tokens."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(tokens), trimmed)


def lenient_double(text: Column) -> Column:
    """Number or NULL; missing-value tokens, letter codes and junk become NULL."""
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def lenient_long(text: Column) -> Column:
    """Whole number or NULL; `12.0` is 12, `12.5` and `Z` are NULL."""
    # a failed cast is far dearer than a failed match
    return F.when(text.rlike(_WHOLE), F.regexp_extract(text, _WHOLE, 1).try_cast("bigint"))


def strict_double(text: Column) -> Column:
    """Number, NULL for a missing-value token; anything else fails the job."""
    return blank_tokens(text).cast("double")


def strict_long(text: Column) -> Column:
    return blank_tokens(text).cast("bigint")


def date_from_compact(value: Column) -> Column:
    """`yyyyMMdd` held as a number or a string."""
    return F.to_date(value.cast("string"), "yyyyMMdd")


def date_from_slashes(text: Column) -> Column:
    """Day first, with or without leading zeros: `1/2/2000` is 1 February."""
    return F.to_date(blank_tokens(text), "d/M/yyyy")


def month_index(date: Column) -> Column:
    """`year * 12 + month`: consecutive calendar months differ by one."""
    return (F.year(date) * 12 + F.month(date)).cast("bigint")


def month_index_from_yyyymm(yyyymm: Column) -> Column:
    year = F.floor(yyyymm / F.lit(100)).cast("bigint")
    return year * 12 + yyyymm.cast("bigint") % 100


def is_finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite (never NULL itself)."""
    wide = value.cast("double")
    return wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf")))
