"""Calendars, dense grids and contiguous runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DAY, micros
from .ordered import ordinals


def calendar(bars: DataFrame, at: str = "at") -> DataFrame:
    """(at, bar): every stamp any symbol has, numbered from 1."""
    return ordinals(bars, at, F.floor(micros(bars, at) / F.lit(32 * DAY)))


def with_bar(bars: DataFrame, at: str = "at") -> DataFrame:
    """bars with the global bar ordinal, the dense rank of at over all symbols."""
    return bars.join(calendar(bars, at), at)


def bar_grid(bars: DataFrame, at: str = "at") -> DataFrame:
    """Every symbol on every global bar from its own first bar on; bars carries the ordinal column bar.

    Bars before a symbol's first are left out, since nothing is known there.
    Columns other than symbol, at and bar are NULL on the added rows.
    """
    stamps = bars.select(at, "bar").distinct()
    last = bars.agg(F.max("bar")).scalar()
    spine = (bars.groupBy("symbol").agg(F.min("bar").alias("__first"))
             .select("symbol", F.explode(F.sequence("__first", last)).alias("bar"))
             # The exploded rows, not the few symbols they come from, decide the partition count.
             .repartition("symbol").join(stamps, "bar"))
    rest = [c for c in bars.columns if c not in ("symbol", at, "bar")]
    return (spine.join(bars.select("symbol", "bar", *rest), ["symbol", "bar"], "left")
            .select("symbol", at, "bar", *rest))


def period_grid(rows: DataFrame, keys: Sequence[str], period: str, last: Column, step: Column) -> DataFrame:
    """keys on every period from each key's first to last."""
    return (rows.groupBy(*keys).agg(F.min(period).alias("__first"), F.max(last).alias("__last"))
            .select(*keys, F.explode(F.sequence("__first", "__last", step)).alias(period)).repartition(*keys))


def regular(rows: DataFrame, keys: Sequence[str], at: str, step: str = "1 hour") -> DataFrame:
    """rows on every step between each key's first and last stamp; added rows carry NULLs."""
    keys = list(keys)
    spine = (rows.groupBy(*keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
             .select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr(f"interval {step}"))).alias(at)).repartition(*keys))
    return spine.join(rows, [*keys, at], "left")


def islands(days: DataFrame, keys: Sequence[str], day: str = "day", step: int = 1) -> DataFrame:
    """Contiguous runs of a distinct day set per key as (first, last, days)."""
    keys = list(keys)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(day)
    run = F.unix_date(day) - F.row_number().over(w) * F.lit(step)
    return (days.withColumn("__run", run).groupBy(*keys, "__run")
            .agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("days"))
            .drop("__run"))
