"""Period panels: one row per (symbol, period) on a dense grid, from long bars.

by names extra keys a panel is built per, such as the rebalance weekday of a
sliced book; windows then run per (by, symbol), so a sweep is one job. Lags
and rolling windows count periods, never rows, because the grid is dense.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import at_least, rolling, rolling_median, week_end
from .grid import bar_grid, period_grid
from .quantiles import trailing

SORTED = 256  # rows of a frame up to which a bar sorts its own


def own(by: Sequence[str] = ()):
    return Window.partitionBy(*by, "symbol").orderBy("period")


def past(n: int, by: Sequence[str] = ()):
    """The last n periods, this one included."""
    return own(by).rowsBetween(-(n - 1), 0)


def lagged(name: str, by: Sequence[str] = (), n: int = 1) -> Column:
    return F.lag(name, n).over(own(by))


def rolled_bars(bars: DataFrame, rows: int = 30, least: int = 20) -> DataFrame:
    """bars on the dense global bar grid with the rolling median dollar volume and the flags periods need.

    Long spans slide (see quantiles); sorting a short one for each bar is cheaper than a Python worker.
    """
    g = bar_grid(bars)
    w = Window.partitionBy("symbol").orderBy("bar")
    g = g.withColumn("traded", F.coalesce("traded", F.lit(False)))
    # On the dense grid the last rows bars are a span of bar numbers.
    g = (g.withColumn("__liq", rolling_median("dollar_volume", w.rowsBetween(-(rows - 1), 0), least)) if rows <= SORTED
         else trailing(g, ["symbol"], F.col("bar"), "dollar_volume", {"__liq": 0.5}, least, rows))
    return (g
            .withColumn("__reopen", F.col("traded") & ~F.coalesce(F.lag("traded").over(w), F.lit(False)))
            .withColumn("__later", F.coalesce(F.max(F.when(F.col("traded"), F.col("bar"))).over(Window.partitionBy("symbol"))
                                              >= F.col("bar"), F.lit(False))))


def build(bars: DataFrame, weekday: str | Column = "SUN", min_bars: int = 5, liquidity_bars: int = 30,
          liquidity_min: int = 20, vol_periods: int = 12, vol_min: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """(by, symbol, period, returns, pnl, liquidity, vol, funding, halted, gap) from long bars.

    bars carry symbol, at, bar, traded, dollar_volume, returns, held and
    optionally funding. With by, weekday is a Column over those keys (see
    sliced) and the keys are already on the bars.
    """
    if "funding" not in bars.columns:
        bars = bars.withColumn("funding", F.lit(0.0))
    keep = bars.select("symbol", "at", "bar", "traded", "dollar_volume", "returns", "held", "funding")
    rolled = rolled_bars(keep, liquidity_bars, liquidity_min)
    return _periods(rolled, weekday, min_bars, vol_periods, vol_min, by)


def sliced(bars: DataFrame, weekdays: Sequence[int] = range(7), **kw) -> DataFrame:
    """One panel per rebalance weekday (Monday = 0), keyed by slice, from one pass over the bars."""
    kw = {"min_bars": 5, "liquidity_bars": 30, "liquidity_min": 20, "vol_periods": 12, "vol_min": 8, **kw}
    keep = bars if "funding" in bars.columns else bars.withColumn("funding", F.lit(0.0))
    rolled = rolled_bars(keep.select("symbol", "at", "bar", "traded", "dollar_volume", "returns", "held", "funding"),
                         kw["liquidity_bars"], kw["liquidity_min"])
    rolled = rolled.withColumn("slice", F.explode(F.array(*[F.lit(d) for d in weekdays])))
    return _periods(rolled, F.col("slice"), kw["min_bars"], kw["vol_periods"], kw["vol_min"], ("slice",))


def _periods(rolled: DataFrame, weekday, min_bars, vol_periods, vol_min, by) -> DataFrame:
    by = list(by)
    rows = rolled.withColumn("period", week_end("at", weekday))
    held_gap = F.when(F.col("__reopen"), F.col("held"))
    agg = rows.groupBy(*by, "symbol", "period").agg(
        at_least(min_bars, F.sum("returns"), F.count("returns")).alias("returns"),
        F.expm1(F.sum("held")).alias("pnl"),
        F.max_by("__liq", F.when(F.col("__liq").isNotNull(), F.col("bar"))).alias("__liq"),
        F.sum(F.coalesce("funding", F.lit(0.0))).alias("funding"),
        F.sum(held_gap).alias("gap"),
        F.max_by(~F.col("traded"), "bar").alias("__idle"),
        F.max_by("__later", "bar").alias("__later"),
        F.max("at").alias("last_at"))
    spine = period_grid(agg, [*by, "symbol"], "period", F.col("period"), F.expr("interval 7 days"))
    p = spine.join(agg, [*by, "symbol", "period"], "left")
    w = own(by)
    p = (p.withColumn("__vol", rolling(F.stddev_samp, F.col("returns"), past(vol_periods, by), vol_min))
         .withColumn("__halted", F.coalesce(F.col("__idle") & F.col("__later"), F.lit(False))))
    return p.select(*by, "symbol", "period", "returns", "pnl",
                    F.lag("__liq").over(w).alias("liquidity"), F.lag("__vol").over(w).alias("vol"),
                    F.coalesce("funding", F.lit(0.0)).alias("funding"),
                    F.coalesce(F.lag("__halted").over(w), F.lit(False)).alias("halted"), "gap", "last_at")


def simple_periods(bars: DataFrame, min_bars: int = 5, weekday: str = "SUN") -> DataFrame:
    """Period log return with its count of valid bars, without the grid."""
    return (bars.groupBy("symbol", week_end("at", weekday).alias("period"))
            .agg(at_least(min_bars, F.sum("returns"), F.count("returns")).alias("returns"),
                 F.count("returns").alias("bars")))


def spread_down(bars: DataFrame, panel: DataFrame, columns: Sequence[str], weekday: str = "SUN") -> DataFrame:
    """bars with the given panel columns of the period that encloses each bar."""
    return (bars.withColumn("period", week_end("at", weekday))
            .join(panel.select("symbol", "period", *columns), ["symbol", "period"], "left"))


def at_close(bars: DataFrame, columns: Sequence[str], weekday: str = "SUN") -> DataFrame:
    """Each feature's last non-null value in the period, per symbol."""
    return (bars.groupBy("symbol", week_end("at", weekday).alias("period"))
            .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in columns]))


def market_return(panel: DataFrame, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, market): the mean period return over coins with liquidity of at least floor.

    Every period is kept, with a NULL market where no coin qualifies.
    """
    return (panel.groupBy(*by, "period")
            .agg(F.avg(F.when(F.col("liquidity") >= floor, F.col("returns"))).alias("market")))
