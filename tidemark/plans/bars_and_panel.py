"""Queries for bars, panels, grids and as-of placement (B, P, Q, J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DAY, HOUR, week_end
from ..functions import moments as M
from ..operators import asof, bars as B, book as K, costs as C, grid as G, panel as P, quality as Q, signals as S, stats as R
from ..session import settle
from . import views as V
from .oracle_views import CTES, FLAT_BPS, FLOOR, MIN_BARS, REDENOMINATION, WARMUP
from .registry import query


def long_bars(spark, sf_dir, funding=False):
    b = B.long_bars(V.stored_bars(spark, sf_dir), warmup=WARMUP, redenominations=[REDENOMINATION])
    return B.with_funding(b, V.prints(spark, sf_dir)) if funding else b


def stored_long(spark, sf_dir):
    return settle(long_bars(spark, sf_dir, funding=True))


def rolled(spark, sf_dir):
    b = B.with_vol(stored_long(spark, sf_dir), 60 * DAY, 10)
    return B.with_liquidity(b, 30 * DAY, 5)


def panel(spark, sf_dir, min_bars=MIN_BARS):
    return P.build(stored_long(spark, sf_dir), min_bars=min_bars)


def stored_panel(spark, sf_dir, min_bars=MIN_BARS):
    return settle(panel(spark, sf_dir, min_bars))


def trend_weights(spark, sf_dir, n=2, p=None):
    return K.inverse_vol(S.trend_sign(p if p is not None else panel(spark, sf_dir), n), floor=FLOOR)


def net_series(spark, sf_dir, book_id="trend"):
    """The trend book as (book_id, t, r)."""
    r = K.run(trend_weights(spark, sf_dir), C.flat(FLAT_BPS))
    return r.select(F.lit(book_id).alias("book_id"), F.col("period").alias("t"), F.col("net").alias("r"))


def flagship(spark, sf_dir):
    # At the smallest scale few weeks have two valid returns, so one is enough and sizing needs less history.
    b = B.with_funding(B.long_bars(V.stored_bars(spark, sf_dir), warmup=0, redenominations=[REDENOMINATION]), V.prints(spark, sf_dir))
    p = P.build(settle(b), min_bars=1, liquidity_min=1, vol_min=2)
    w = K.inverse_vol(S.trend_sign(p, 1), floor=0.0)
    return K.run(w, C.flat(FLAT_BPS)).select("period", "gross", "funding", "cost", "turnover", "net")


@query("b1_traded", "symbol at traded", "SELECT symbol, at, volume > 0 AS traded FROM bd")
def _(s, d):
    return B.with_traded(V.bars(s, d))


@query("b2_bar_ordinal", "symbol at bar", "SELECT bd.symbol, bd.at, bar FROM bd JOIN cal ON bd.at = cal.at")
def _(s, d):
    return G.with_bar(V.stored_bars(s, d))


@query("b3_returns", "symbol at returns~8", "SELECT symbol, at, returns FROM lb")
def _(s, d):
    return long_bars(s, d)


@query("b4_held", "symbol at held~8", "SELECT symbol, at, held FROM lb")
def _(s, d):
    return long_bars(s, d)


@query("b5_dollar_volume", "symbol at dollar_volume~4", "SELECT symbol, at, dollar_volume FROM lb0")
def _(s, d):
    return B.with_dollar_volume(V.bars(s, d))


@query("b6_funding_on_bars", "symbol at funding~10", "SELECT symbol, at, funding FROM lbf")
def _(s, d):
    return B.with_funding(V.stored_bars(s, d), V.prints(s, d))


@query("b7_funding_floor", "symbol at funding~10",
       "SELECT bd.symbol, bd.at, coalesce(funding_rate, 0) AS funding FROM bd LEFT JOIN prints ON bd.symbol = prints.symbol AND bd.at = prints.t")
def _(s, d):
    return B.with_funding_floor(V.bars(s, d), V.prints(s, d))


@query("b8_trailing_vol", "symbol at vol~8", "SELECT symbol, at, vol FROM rolled")
def _(s, d):
    return B.with_vol(long_bars(s, d), 60 * DAY, 10)


@query("b9_trailing_liquidity", "symbol at liquidity~4", "SELECT symbol, at, liquidity FROM rolled")
def _(s, d):
    return B.with_liquidity(long_bars(s, d), 30 * DAY, 5)


@query("b10_market_return", "symbol at market~8", "SELECT symbol, r.at, market FROM rolled r LEFT JOIN mkt ON r.at = mkt.at")
def _(s, d):
    return B.with_market(settle(rolled(s, d)), FLOOR)


@query("b11_residual_vol", "symbol at residual~8 residual_vol~8", """
SELECT symbol, at, residual, lag(v) OVER (PARTITION BY symbol ORDER BY at) AS residual_vol FROM (
  SELECT *, CASE WHEN count(residual) OVER w >= 10 THEN stddev_samp(residual) OVER w END AS v FROM (
    SELECT r.symbol, r.at, returns - market AS residual FROM rolled r LEFT JOIN mkt ON r.at = mkt.at)
  WINDOW w AS (PARTITION BY symbol ORDER BY at RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW))""")
def _(s, d):
    return B.with_residual(B.with_market(settle(rolled(s, d)), FLOOR), 60 * DAY, 10)


@query("b12_coin_age", "symbol period age", """
SELECT symbol, period, lag(age) OVER (PARTITION BY symbol ORDER BY period) AS age FROM (
  SELECT symbol, at + (7 - isodow(at))::INTEGER AS period, CAST(max(age) AS BIGINT) AS age FROM (
    SELECT symbol, at, sum(CASE WHEN volume > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY at ROWS UNBOUNDED PRECEDING) AS age FROM bd)
  GROUP BY 1, 2)""")
def _(s, d):
    a = P.at_close(B.with_age(B.with_traded(V.bars(s, d))), ["age"])
    return a.withColumn("age", F.lag("age").over(P.own()))


OHLCV = """SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS open_time, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS t,
       arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(qty) AS volume, count(*) AS trades
FROM trades GROUP BY 1, 2"""


@query("b13_ohlcv", "symbol open_time t open~6 high~6 low~6 close~6 volume~6 trades", OHLCV)
def _(s, d):
    return B.ohlcv(V.trades(s, d), "1 hour")


@query("b14_coarser_bars", "symbol open_time open~6 high~6 low~6 close~6 volume~6", """
SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS open_time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, ts) AS close, sum(qty) AS volume FROM trades GROUP BY 1, 2""")
def _(s, d):
    return B.coarser(B.ohlcv(V.trades(s, d), "1 hour"), "DAY", "open_time")


@query("b15_regular_grid", "symbol open_time close~6", f"""
SELECT g.symbol, g.open_time, h.close FROM (
  SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 HOUR)) AS open_time FROM ({OHLCV}) GROUP BY 1) g
LEFT JOIN ({OHLCV}) h ON g.symbol = h.symbol AND g.open_time = h.open_time""")
def _(s, d):
    return G.regular(settle(B.ohlcv(V.trades(s, d), "1 hour")), ["symbol"], "open_time")


@query("p1_week_label", "at sun wed", "SELECT DISTINCT at, at + (7 - isodow(at))::INTEGER AS sun, at + ((3 - isodow(at) + 7) % 7)::INTEGER AS wed FROM bd")
def _(s, d):
    return V.bars(s, d).select("at").distinct().select("at", week_end("at").alias("sun"), week_end("at", "WED").alias("wed"))


@query("p2_period_return", "symbol period returns~8 bars", f"""
SELECT symbol, at + (7 - isodow(at))::INTEGER AS period, CASE WHEN count(returns) >= {MIN_BARS} THEN sum(returns) END AS returns,
       count(returns) AS bars FROM lb GROUP BY 1, 2""")
def _(s, d):
    return P.simple_periods(long_bars(s, d), MIN_BARS)


for _name, _cols in {"p3_period_liquidity": "liquidity~4", "p4_period_vol": "vol~8", "p5_period_funding": "funding~10",
                     "p6_halt_gaps": "gap~8", "p7_pnl_return": "pnl~8", "p8_halted": "halted",
                     "p9_panel": "returns~8 pnl~8 liquidity~4 vol~8 funding~10 halted gap~8"}.items():
    query(_name, f"symbol period {_cols}", f"SELECT symbol, period, {', '.join(c.split('~')[0] for c in _cols.split())} FROM panel")(
        lambda s, d: panel(s, d))


@query("p10_panel_load", "symbol period returns~8 liquidity~4", """
SELECT symbol, period, returns, liquidity FROM panel""", ctes={"bd": CTES["bd"].replace("GROUP BY", "WHERE p_brand LIKE '%2' GROUP BY")})
def _(s, d):
    # The universe is a table, so choosing it is a semi join that prunes before anything is built.
    listed = V.table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    universe = listed.filter(F.endswith("symbol", F.lit("2")))
    b = settle(V.bars(s, d).join(universe, "symbol", "left_semi"))
    b = B.with_funding(B.long_bars(b, warmup=WARMUP, redenominations=[REDENOMINATION]), V.prints(s, d))
    return P.build(settle(b), min_bars=MIN_BARS)


@query("p11_spread_down", "symbol at liquidity~4", """
SELECT lb.symbol, lb.at, panel.liquidity FROM lb LEFT JOIN panel ON lb.symbol = panel.symbol AND panel.period = lb.at + (7 - isodow(lb.at))::INTEGER""")
def _(s, d):
    b = stored_long(s, d)
    return P.spread_down(b, P.build(b, min_bars=MIN_BARS), ["liquidity"])


@query("p12_close_sampling", "symbol period vol~8", """
SELECT symbol, at + (7 - isodow(at))::INTEGER AS period, arg_max(vol, at) FILTER (vol IS NOT NULL) AS vol FROM rolled GROUP BY 1, 2""")
def _(s, d):
    return P.at_close(rolled(s, d), ["vol"])


@query("k4_book_run", "period gross~8 funding~8 cost~8 turnover~8 net~8", "SELECT period, gross, funding, cost, turnover, net FROM book")
def _(s, d):
    return K.run(trend_weights(s, d), C.flat(FLAT_BPS))


@query("r1_sharpe", "book_id sharpe~8", "SELECT 'trend' AS book_id, avg(net) / stddev_pop(net) * sqrt(52) AS sharpe FROM book")
def _(s, d):
    return R.sharpe(net_series(s, d))
