"""Trend signals on period panels. Each adds a column known at the close before the period it trades."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import corr, clip, div, rolling
from .book import _per, inverse_vol
from .panel import lagged, market_return, own, past


def trail(x: Column, n: int, by: Sequence[str] = (), least: int | None = None) -> Column:
    """The sum of x over the last n periods, all of them present unless least says otherwise."""
    return rolling(F.sum, x, past(n, by), n if least is None else least)


def trend_sign(panel: DataFrame, n: int, by: Sequence[str] = (), name: str = "signal", lag: int = 1) -> DataFrame:
    """Sign of the trailing n-period return, lagged."""
    out = panel.withColumn(name, F.signum(trail(F.col("returns"), n, by)))
    return out.withColumn(name, lagged(name, by, lag)) if lag else out


def lookback_sweep(panel: DataFrame, lookbacks: Sequence[int], by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """The trend sign at every lookback, one row per (symbol, period, lookback): the sweep is a column of the frame."""
    out = panel
    for n in lookbacks:
        out = out.withColumn(f"__s{n}", F.signum(trail(F.col("returns"), n, by)))
    if lag:
        for n in lookbacks:
            out = out.withColumn(f"__s{n}", lagged(f"__s{n}", by, lag))
    pairs = F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"__s{n}").alias("signal")) for n in lookbacks])
    return (out.withColumn("__p", F.explode(pairs)).select(*panel.columns, "__p.lookback", "__p.signal"))


def band(panel: DataFrame, lookbacks: Sequence[int] = (3, 4, 5, 6), by: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """Mean of the trend signs over several lookbacks, all present."""
    votes = [F.signum(trail(F.col("returns"), n, by)) for n in lookbacks]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    out = panel.withColumn("signal", total / F.lit(len(lookbacks)))
    return out.withColumn("signal", lagged("signal", by, lag)) if lag else out


def basket(panel: DataFrame, floor: float, by: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """Every liquid coin with a return in the period before, long at inverse volatility."""
    sig = panel.withColumn("__one", F.when(lagged("returns", by).isNotNull(), F.lit(1.0)))
    return inverse_vol(sig, "__one", floor, by=by, name=name).drop("__one")


def market_timing(panel: DataFrame, n: int, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, timing): 1 or -1 as the liquid coins' mean return over the n periods before rose or fell, 0 if neither."""
    w = _per(by).orderBy("period")
    m = market_return(panel, floor, by)
    m = m.withColumn("__t", F.signum(rolling(F.sum, F.col("market"), w.rowsBetween(-(n - 1), 0), n)))
    return m.select(*by, "period", F.lag("__t").over(w).alias("timing"))


def market_book(panel: DataFrame, n: int, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """basket with every weight turned by market_timing, so that it stands wholly on one side."""
    t = market_timing(panel, n, floor, by)
    return (basket(panel, floor, by).join(t, [*by, "period"], "left")
            .withColumn("weight", F.col("weight") * F.col("timing")).drop("timing"))


def lines(grid: DataFrame, days: int) -> DataFrame:
    """Trailing line fit of the cumulative log level on the bar ordinal, per symbol on the dense bar grid.

    Adds trail, corr and slope over the last days bars, NULL below 5 in 7
    valid returns.
    """
    need = -(-days * 5 // 7)
    w = Window.partitionBy("symbol").orderBy("bar")
    frame = w.rowsBetween(-(days - 1), 0)
    g = grid.withColumn("__level", F.sum(F.coalesce("returns", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x, y = F.col("bar").cast("double"), F.col("__level")
    enough = (F.count("returns").over(frame) >= need) & (F.count(F.lit(1)).over(frame) == days)
    return (g.withColumn("trail", F.when(F.count("returns").over(frame) >= need, F.sum("returns").over(frame)))
            .withColumn("corr", F.when(enough & (F.var_samp(y).over(frame) > 0), corr(y, x, frame)))
            .withColumn("slope", F.when(enough, div(F.covar_samp(y, x).over(frame), F.var_samp(x).over(frame))))
            .drop("__level"))


def line_parts(panel: DataFrame, closes: DataFrame, days: int, per_week: int, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Sign of the trailing return, slope direction, steepness z and fit r2 at each rebalance close.

    closes carries (symbol, period, trail, slope, corr) sampled at the close
    (panel.at_close). Steepness is the fitted move in units of the coin's own
    volatility over the window.
    """
    w = own(by)
    j = panel.join(closes, ["symbol", "period"], "left")
    nv = F.lead("vol").over(w)
    ok = (F.lead("liquidity").over(w) >= floor) & nv.isNotNull() & F.col("trail").isNotNull()
    z = div(F.abs("slope") * F.lit(float(days)), nv * F.sqrt(F.lit(days / per_week)))
    return (j.withColumn("z", F.when(ok, z)).withColumn("sign", F.signum("trail"))
            .withColumn("direction", F.signum("slope")).withColumn("r2", F.col("corr") * F.col("corr")))


def strict_rule(parts: DataFrame, z_cut: float = 2.0, r2_cut: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """The slope's direction where the line clears both cuts, lagged into signal."""
    out = parts.withColumn("signal", F.when((F.col("z") >= z_cut) & (F.col("r2") >= r2_cut), F.col("direction")))
    return out.withColumn("signal", lagged("signal", by))


def clock_fit(bars: DataFrame, days: int, at: str = "open_time", per_day: int = 24) -> DataFrame:
    """Correlation of log close with time over the trailing days, per symbol, from running sums of moments.

    Each row's window sums are a difference of two running sums, found by an
    equality join on the ordinal, so cost per row does not grow with the
    window. Bars lie on a regular grid (grid.regular); missing closes are NULL.
    """
    w = Window.partitionBy("symbol").orderBy(at)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol")
    y0 = F.log("close")
    b = bars.withColumn("__i", F.row_number().over(w) - 1).withColumn("__y0", y0)
    b = (b.withColumn("__y", F.coalesce(F.col("__y0") - F.avg("__y0").over(whole), F.lit(0.0)))
         .withColumn("__n", F.col("__y0").isNotNull().cast("double"))
         .withColumn("__t", (F.col("__i") - F.count(F.lit(1)).over(whole) / 2) / F.lit(float(per_day))))
    sums = {"n": F.col("__n"), "y": F.col("__y"), "yy": F.col("__y") ** 2, "t": F.col("__n") * F.col("__t"),
            "tt": F.col("__n") * F.col("__t") ** 2, "ty": F.col("__y") * F.col("__t")}
    c = b.select("symbol", at, "__i", *[F.sum(e).over(run).alias(k) for k, e in sums.items()])
    span = days * per_day
    back = {k: F.col(k) - F.coalesce(F.lag(k, span).over(w), F.lit(0.0)) for k in sums}
    d = c.select("symbol", at, "__i", *[e.alias(k) for k, e in back.items()])
    n, y, yy, t, tt, ty = (F.col(k) for k in ("n", "y", "yy", "t", "tt", "ty"))
    spread = (n * tt - t * t) * (n * yy - y * y)
    corr = div(n * ty - t * y, F.sqrt(F.when(spread > 0, spread)))
    ok = (n >= span * 5 / 7) & (F.col("__i") + 1 >= span)
    return d.select("symbol", at, F.when(ok, corr).alias("corr"))


def breakout(panel: DataFrame, n: int, by: Sequence[str] = (), name: str = "signal") -> DataFrame:
    """+1 at a new n-period high of the level, -1 at a new low, which wins ties, else 0. Not lagged."""
    w = own(by)
    p = panel.withColumn("__cum", F.when(F.col("returns").isNotNull(),
                                         F.sum("returns").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    level = F.col("__cum")
    hi, lo = rolling(F.max, level, past(n, by), n), rolling(F.min, level, past(n, by), n)
    return (p.withColumn(name, F.when(level <= lo, -1.0).when(level >= hi, 1.0).otherwise(0.0)).drop("__cum"))


def efficiency(panel: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds er, the net move over the summed moves of the last n periods."""
    return panel.withColumn("er", div(F.abs(trail(F.col("returns"), n, by)), trail(F.abs("returns"), n, by)))


def cross_thirds(panel: DataFrame, x: str, eligible: Column, by: Sequence[str] = (), name: str = "third") -> DataFrame:
    """0, 1, 2 for the low, mid and high third of x across the eligible coins of each period."""
    v = F.when(eligible, F.col(x))
    w = Window.partitionBy(*by, "period")
    lo, hi = F.percentile(v, F.lit(1 / 3)).over(w), F.percentile(v, F.lit(2 / 3)).over(w)
    return panel.withColumn(name, F.when(v <= lo, 0).when(v >= hi, 2).when(v.isNotNull(), 1).cast("bigint"))


def residual_momentum(panel: DataFrame, n: int, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds own, mkt and resid: the coin's trailing return, the market's and their difference."""
    w = _per(by).orderBy("period")
    m = market_return(panel, floor, by).withColumn("mkt", rolling(F.sum, F.col("market"), w.rowsBetween(-(n - 1), 0), n))
    return (panel.withColumn("own", trail(F.col("returns"), n, by))
            .join(m.select(*by, "period", "mkt"), [*by, "period"], "left")
            .withColumn("resid", F.col("own") - F.col("mkt")))


def funding_aware(panel: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds signal, the sign of the trailing return less the trailing funding. Not lagged."""
    return panel.withColumn("signal", F.signum(trail(F.col("returns"), n, by) - trail(F.col("funding"), n, by)))


def rolling_beta(panel: DataFrame, market: DataFrame, window: int = 26, least: int = 13, by: Sequence[str] = ()) -> DataFrame:
    """Adds beta, the trailing covariance with the market series (by, period, mk) over its variance, lagged."""
    m = _per(by).orderBy("period")
    series = market.withColumn("__mv", rolling(F.var_samp, F.col("mk"), m.rowsBetween(-(window - 1), 0), least))
    j = panel.join(series, [*by, "period"], "left")
    both = F.when(F.col("returns").isNotNull(), F.col("mk"))
    cov = F.when(F.count(both).over(past(window, by)) >= least,
                 F.covar_samp("returns", both).over(past(window, by)))
    j = j.withColumn("__beta", div(cov, F.col("__mv")))
    return j.withColumn("beta", lagged("__beta", by)).drop("__beta", "__mv")


def beta_neutral(weights: DataFrame, base: str, by: Sequence[str] = ()) -> DataFrame:
    """weights less the base weights times the book's net exposure, then less its remaining beta exposure.

    base names the column of basket weights; adds market_part, rest and neutral.
    """
    w = Window.partitionBy(*by, "period")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = weights.withColumn("market_part", z(base) * F.sum(z("weight")).over(w))
    out = out.withColumn("rest", z("weight") - F.col("market_part"))
    return out.withColumn("neutral", F.col("rest") - z(base) * F.sum(F.col("rest") * F.col("beta")).over(w))


def capped_move(limit: float = 2.0) -> Column:
    """The period's move held within limit volatilities, as a simple return; the booked return where there is no signal return."""
    z = clip(div(F.col("returns"), F.col("vol")), -limit, limit) * F.col("vol")
    return F.when(F.col("returns").isNotNull(), F.expm1(z)).otherwise(F.col("pnl"))


def zscore(panel: DataFrame, x: str, eligible: Column, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """(x - mean) / sample spread across the eligible coins of each period."""
    v = F.when(eligible, F.col(x))
    w = Window.partitionBy(*by, "period")
    return panel.withColumn(name, div(v - F.avg(v).over(w), F.stddev_samp(v).over(w)))


def oi_features(oi: DataFrame, change: int = 4, window: int = 26, least: int = 13) -> DataFrame:
    """(period, growth, level): contracts growth and deviation from their trailing mean, averaged over symbols, lagged.

    oi carries (symbol, period, oi_value, returns) on a dense grid; contracts
    are the log value less the cumulative return.
    """
    w = own()
    x = oi.withColumn("__c", F.log("oi_value") - F.when(
        F.col("returns").isNotNull(), F.sum("returns").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    x = (x.withColumn("__g", F.col("__c") - F.lag("__c", change).over(w))
         .withColumn("__d", F.col("__c") - rolling(F.avg, F.col("__c"), past(window), least)))
    m = x.groupBy("period").agg(F.avg("__g").alias("__g"), F.avg("__d").alias("__d"))
    o = _per(()).orderBy("period")
    return m.select("period", F.lag("__g").over(o).alias("growth"), F.lag("__d").over(o).alias("level"))


def vol_scaled_long(closes: DataFrame, target: float = 0.01, cap: float = 3.0, window: int = 8) -> DataFrame:
    """(period, plain, scaled): the mean next return of every symbol, and of each scaled to target vol up to cap.

    closes carries (symbol, period, close) on a dense grid.
    """
    w = own()
    x = closes.withColumn("__r", div(F.col("close"), F.lag("close").over(w)) - 1)
    x = (x.withColumn("__f", F.lead("__r").over(w))
         .withColumn("__k", clip(div(F.lit(target), rolling(F.stddev_samp, F.col("__r"), past(window), window)), hi=cap)))
    x = x.withColumn("__k", lagged("__k"))
    return (x.groupBy("period").agg(F.avg("__f").alias("plain"), F.avg(F.col("__f") * F.col("__k")).alias("scaled"))
            .filter(F.col("plain").isNotNull()))


def flip_book(closes: DataFrame, n: int, cost_bps: float = 10.0) -> DataFrame:
    """Per symbol and period: the sign of the change over n periods earns the next return, pays funding and a cost on each flip.

    closes carries (symbol, period, close, funding), the funding the next period pays.
    """
    w = own()
    x = (closes.withColumn("sig", F.signum(div(F.col("close"), F.lag("close", n).over(w)) - 1))
         .withColumn("fwd", div(F.lead("close").over(w), F.col("close")) - 1)
         .filter(F.col("sig").isNotNull() & F.col("fwd").isNotNull()))
    prev = F.lag("sig").over(w)
    return (x.withColumn("flip", (prev.isNull() | (F.col("sig") != prev)).cast("double"))
            .withColumn("gross", F.col("sig") * F.col("fwd"))
            .withColumn("paid", -F.col("sig") * F.coalesce("funding", F.lit(0.0)))
            .withColumn("net", F.col("gross") + F.col("paid") - F.col("flip") * F.lit(cost_bps / 1e4))
            .select("symbol", "period", "gross", "paid", "flip", "net"))


def placebo(panel: DataFrame, runs: int = 20, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Random-sign signals, one row per run: the parity of the first 32 bits of MD5 over symbol|period|run|seed, the same on any engine."""
    draw = F.md5(F.concat_ws("|", "symbol", F.col("period").cast("string"), F.col("run").cast("string"), F.lit(str(seed))))
    sign = F.when(F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") % 2 == 0, 1.0).otherwise(-1.0)
    live = panel.withColumn("__live", lagged("returns", by).isNotNull())
    return (live.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
            .withColumn("signal", F.when(F.col("__live"), sign)).drop("__live"))


def index_paths(panel: DataFrame, floor: float, single: str) -> DataFrame:
    """(period, equal, volume_weighted, single) returns of tradeable coins, and their running sums, where all three exist."""
    ok = F.col("liquidity") >= floor
    r = F.when(ok, F.col("returns"))
    w = F.when(ok & F.col("returns").isNotNull(), F.col("liquidity"))
    x = (panel.groupBy("period").agg(
        F.avg(r).alias("equal"), div(F.sum(r * F.col("liquidity")), F.sum(w)).alias("volume_weighted"),
        F.max(F.when(F.col("symbol") == single, F.col("returns"))).alias("single"))
        .filter(F.col("equal").isNotNull() & F.col("volume_weighted").isNotNull() & F.col("single").isNotNull()))
    run = _per(()).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("equal", "volume_weighted", "single"):
        x = x.withColumn(f"{c}_path", F.sum(c).over(run))
    return x
