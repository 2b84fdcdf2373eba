"""Scalar formulas of the panel: returns, size, macro states, robust loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delisting_adjusted(ret: Column, dlret: Column) -> Column:
    """Compound both returns where both exist, otherwise whichever one exists."""
    return F.coalesce((1 + ret) * (1 + dlret) - 1, ret, dlret)


def absolute_price(prc: Column) -> Column:
    """Quotes without a trade carry a minus sign; the magnitude is the price."""
    return F.abs(prc)


def market_cap(prc: Column, shares: Column) -> Column:
    return absolute_price(prc) * shares


def excess_return(ret: Column, risk_free: Column) -> Column:
    return ret - risk_free


def log_ratio(top: Column, bottom: Column) -> Column:
    """NULL when the ratio is undefined or not positive."""
    return F.ln(F.try_divide(top, bottom))


def macro_states(index, d12, e12, book_to_market, ntis, tbl, lty, aaa, baa, svar) -> dict[str, Column]:
    """The eight macro predictors by their short names."""
    return {
        "dp": log_ratio(d12, index),
        "ep": log_ratio(e12, index),
        "bm": book_to_market,
        "ntis": ntis,
        "tbl": tbl,
        "tms": lty - tbl,
        "dfy": baa - aaa,
        "svar": svar,
    }


def huber_psi(residual: Column, xi: Column) -> Column:
    """Half the slope of the Huber loss: the residual, clipped to [-xi, xi]."""
    return F.when(F.abs(residual) <= xi, residual).otherwise(xi * F.signum(residual))


def huber_loss(residual: Column, xi: Column) -> Column:
    size = F.abs(residual)
    return F.when(size <= xi, residual * residual).otherwise(2 * xi * size - xi * xi)


def huber_weight(residual: Column, xi: Column) -> Column:
    """psi / residual, one where the residual is inside the threshold (zero included)."""
    return F.when(F.abs(residual) <= xi, F.lit(1.0)).otherwise(F.try_divide(xi, F.abs(residual)))
