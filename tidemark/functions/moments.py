"""Aggregate expressions over a return column: one row per book out of any number of books."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col, div


def spread_ok(r) -> Column:
    """More than two values, not all equal."""
    return (F.count(col(r)) > 2) & (F.max(col(r)) > F.min(col(r)))


def sharpe(r, periods: float = 1.0) -> Column:
    """Mean over population spread, annualised; NULL on fewer than three values or no spread."""
    r = col(r)
    return F.when(spread_ok(r), F.avg(r) / F.stddev_pop(r) * F.sqrt(F.lit(float(periods))))


def sharpe_of(n: Column, s: Column, ss: Column, periods: float = 1.0) -> Column:
    """Sharpe from count, sum and sum of squares."""
    mean = s / n
    var = ss / n - mean * mean
    # Below this share of the second moment a difference of sums is rounding, not spread.
    return F.when((n > 2) & (var > ss / n * 1e-12), mean / F.sqrt(F.abs(var)) * F.sqrt(F.lit(float(periods))))


def annual_return(r, periods: float) -> Column:
    return F.avg(col(r)) * F.lit(float(periods))


def volatility(r, periods: float) -> Column:
    return F.stddev_pop(col(r)) * F.sqrt(F.lit(float(periods)))


def t_stat(r) -> Column:
    r = col(r)
    return F.when(spread_ok(r), F.avg(r) / F.stddev_samp(r) * F.sqrt(F.count(r).cast("double")))


def raw_kurtosis(r) -> Column:
    return F.kurtosis(col(r)) + 3
