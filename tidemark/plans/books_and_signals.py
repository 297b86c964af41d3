"""Queries for costs, weights, books and signals (C, K, G-T)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import DAY, HOUR, week_start
from ..operators import asof, bars as B, book as K, costs as C, grid as G, panel as P, signals as S
from ..session import settle
from . import views as V
from .bars_and_panel import long_bars, panel, stored_long, stored_panel, trend_weights
from .oracle_views import CTES, FLAT_BPS, FLOOR, LOOKBACKS, MIN_BARS, sliced_ctes
from .registry import query

FLAT = C.flat(FLAT_BPS)


def sweep_weights(s, d, p=None):
    w = S.lookback_sweep(p if p is not None else panel(s, d), LOOKBACKS).withColumn("lookback", F.col("lookback").cast("bigint"))
    return K.inverse_vol(w, floor=FLOOR, by=("lookback",))


def books(s, d):
    """The lookback sweep's net returns as (book_id, t, r), one job."""
    r = K.run(sweep_weights(s, d), FLAT, by=("lookback",))
    return r.select(F.col("lookback").alias("book_id"), F.col("period").alias("t"), F.col("net").alias("r"))


def market_up(p):
    """On where the average liquid coin rose the period before."""
    m = P.market_return(p, FLOOR)
    w = Window.partitionBy(F.lit(0)).orderBy("period")
    return m.select("period", F.coalesce(F.lag("market").over(w) > 0, F.lit(False)).alias("on"))


UP = "SELECT period, coalesce(lag(market) OVER (ORDER BY period) > 0, false) AS on_ FROM wmarket"

# Costs ------------------------------------------------------------------------------------------------------

@query("c1_cost_models", "symbol period flat~8 prov~8 taker~8", """
SELECT symbol, period, 10.0::DOUBLE AS flat, CASE WHEN liquidity >= 50000 THEN 7.5 ELSE 15.0 END::DOUBLE AS prov,
       5.0 + pow(10, 2.0103404763096764 - 0.2738586941533421 * log10(greatest(liquidity, 1e5)))
       + 50 * 0.05 * 1e6 / pow(10, -0.7160494356491773 + 0.8183787124741141 * log10(greatest(liquidity, 1e5)))
       + CASE WHEN liquidity IS NULL THEN NULL ELSE 0 END AS taker
FROM panel""")
def _(s, d):
    liq, dw = F.col("liquidity"), F.lit(0.05)
    return (panel(s, d).withColumn("flat", FLAT(liq, dw)).withColumn("prov", C.provisional(floor=50000.0)(liq, dw))
            .withColumn("taker", C.taker(5.0, 1e6)(liq, dw)))


EFFECTIVE = """
WITH base AS (
  SELECT symbol, datediff('hour', TIMESTAMP '2024-01-01', ts) AS m, side, price, price * qty AS notional FROM trades
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
w AS (SELECT symbol, width, m // width AS k, sum(price) FILTER (side = 'buy') AS bp, count(*) FILTER (side = 'buy') AS bn,
             sum(price) FILTER (side = 'sell') AS sp, count(*) FILTER (side = 'sell') AS sn
      FROM base, (VALUES (1), (4), (24)) v(width) WHERE (m // width + 1) * width <= 720 GROUP BY 1, 2, 3),
s AS (SELECT symbol, width, quantile_cont((bp / bn - sp / sn) / ((bp / bn + sp / sn) / 2), 0.5) AS spread
      FROM w WHERE bn >= 1 AND sn >= 1 GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT v.symbol, (SELECT min(width) FROM s WHERE s.symbol = v.symbol)::BIGINT AS width,
       (SELECT arg_min(spread, width) FROM s WHERE s.symbol = v.symbol) * 1e4 / 2 AS half_spread_bps, traded_per_day, trades
FROM (SELECT symbol, sum(notional) / 30 AS traded_per_day, count(*) AS trades FROM base GROUP BY 1) v"""


@query("c2_effective_spread", "symbol width half_spread_bps~6 traded_per_day~6 trades",
       f"SELECT symbol, width, half_spread_bps, traded_per_day, trades FROM ({EFFECTIVE})")
def _(s, d):
    return C.effective_spread(V.trades(s, d), "2024-01-01", 30, widths=(1, 4, 24), enough=5, sides=1, unit=HOUR)


def depth_books(s, d):
    """(symbol, at, bids, asks): returned and shipped items per brand and day as the two sides' first band."""
    l = V.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    band = lambda flag: F.array(F.struct(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias("depth"),
                                         F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))).alias("notional")))
    return (l.join(p, "l_partkey").groupBy("symbol", F.col("l_shipdate").cast("date").alias("at"))
            .agg(band("A").alias("bids"), band("N").alias("asks")))


DEPTH = """SELECT symbol, quantile_cont((b + a) / 2, 0.5) AS depth_1pct_usd FROM (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS b,
         sum(l_extendedprice) FILTER (l_returnflag = 'N') AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1"""


@query("c3_depth", "symbol depth_1pct_usd~4", DEPTH)
def _(s, d):
    return C.depth_one_percent(depth_books(s, d))


@query("c4_traded_notional", "symbol day notional~6 trades",
       "SELECT symbol, CAST(ts AS DATE) AS day, sum(price * qty) AS notional, count(*) AS trades FROM trades GROUP BY 1, 2")
def _(s, d):
    return C.traded_notional(V.trades(s, d), ["symbol"])


def quotes(s, d):
    """(symbol, day, bid, ask): each line as a quote around its unit price."""
    l = V.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return l.join(p, "l_partkey").select("symbol", F.col("l_shipdate").cast("date").alias("day"),
                                         (unit * (1 - F.col("l_discount"))).alias("bid"), (unit * (1 + F.col("l_tax") - 0.02)).alias("ask"))


QUOTES = """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity * (1 - l_discount) AS bid,
       l_extendedprice / l_quantity * (1 + l_tax - 0.02) AS ask FROM lineitem JOIN part ON l_partkey = p_partkey"""
QUOTED = f"""SELECT symbol, day, quantile_cont(1e4 * (ask - bid) / (ask + bid), 0.5) AS half_spread_bps, count(*) AS n_events
FROM ({QUOTES}) WHERE bid > 0 AND ask > 0 AND ask - bid >= -1e-9 * ask GROUP BY 1, 2"""
# Equal bid and ask differ by rounding between engines, so the query's quotes keep clear of equality.
QUOTED = QUOTED.replace("ask - bid >= -1e-9 * ask", "ask - bid >= 1e-6 * ask")


def quoted_daily(s, d):
    q = quotes(s, d).filter(F.col("ask") - F.col("bid") >= F.lit(1e-6) * F.col("ask"))
    return C.quoted_half_spread(q, ["symbol", "day"])


@query("c6_quoted_spread", "symbol day half_spread_bps~6 n_events", QUOTED)
def _(s, d):
    return quoted_daily(s, d)


@query("c7_impact", "symbol day impact_bps_per_unit~6 n_trades", """
SELECT symbol, day, quantile_cont(x, 0.5) * 1e4 AS impact_bps_per_unit, count(*) AS n_trades FROM (
  SELECT symbol, CAST(ts AS DATE) AS day, CASE WHEN lag(qty) OVER w > 0 THEN abs(ln(price) - lag(ln(price)) OVER w) / lag(qty) OVER w END AS x
  FROM trades WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, id)) GROUP BY 1, 2 HAVING count(*) >= 2 AND impact_bps_per_unit IS NOT NULL""")
def _(s, d):
    return C.impact_per_unit(V.trades(s, d))


AR = """SELECT symbol, at - (isodow(at) - 1)::INTEGER AS week_start, 1e4 * sqrt(greatest(avg(term), 0)) AS half_spread_bps, count(*) AS n_bars FROM (
  SELECT symbol, at, (ln(close) - ln((high + low) / 2)) * (ln(close) - lead(ln((high + low) / 2)) OVER (PARTITION BY symbol ORDER BY at)) AS term
  FROM bd WHERE high > 0 AND low > 0 AND close > 0) WHERE term IS NOT NULL GROUP BY 1, 2"""


@query("c8_range_spread", "symbol week_start half_spread_bps~3 n_bars", AR)
def _(s, d):
    return C.range_spread(V.bars(s, d))


def daily_impact(s, d, flag):
    l = V.table(s, d, "lineitem").filter(F.col("l_returnflag") == flag).select("l_partkey", "l_shipdate", "l_tax")
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return (l.join(p, "l_partkey").groupBy("symbol", F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.avg("l_tax").alias("impact_bps_per_unit")))


def some_quotes(s, d):
    """Quoted spreads; brands that end in 5 are quoted in the first half of a year only, so that their other weeks need the median."""
    return quoted_daily(s, d).filter(~F.endswith("symbol", F.lit("5")) | (F.month("day") <= 6))


WEEKLY_COSTS = f"""
WITH q AS (SELECT * FROM ({QUOTED}) WHERE symbol NOT LIKE '%5' OR month(day) <= 6),
book AS (SELECT symbol, day - (isodow(day) - 1)::INTEGER AS week_start, quantile_cont(half_spread_bps, 0.5) AS book, count(*) AS n_days_book FROM q GROUP BY 1, 2),
imp AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, avg(l_tax) AS x
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
wk AS (SELECT symbol, flag, day - (isodow(day) - 1)::INTEGER AS week_start, quantile_cont(x, 0.5) AS impact_bps_per_unit, count(*) AS n_days_trade FROM imp GROUP BY 1, 2, 3),
fut0 AS (SELECT coalesce(b.symbol, i.symbol) AS symbol, coalesce(b.week_start, i.week_start) AS week_start, book, n_days_book, impact_bps_per_unit, n_days_trade
         FROM book b FULL JOIN (SELECT * FROM wk WHERE flag = 'N') i ON b.symbol = i.symbol AND b.week_start = i.week_start),
fut AS (SELECT *, coalesce(book, quantile_cont(book, 0.5) OVER (PARTITION BY symbol)) AS half_spread_bps,
               CASE WHEN book IS NOT NULL THEN 'book' ELSE 'book_median' END AS half_spread_source FROM fut0)
SELECT symbol, 'futures' AS venue, week_start, half_spread_bps, half_spread_source, impact_bps_per_unit, 5.0 AS taker_fee_bps, n_days_book, n_days_trade FROM fut
UNION ALL
SELECT i.symbol, 'spot', i.week_start, f.half_spread_bps, 'futures_' || f.half_spread_source, i.impact_bps_per_unit, 10.0, NULL, i.n_days_trade
FROM (SELECT * FROM wk WHERE flag = 'A') i LEFT JOIN fut f ON f.symbol = i.symbol AND f.week_start = i.week_start"""
COST_COLUMNS = "symbol venue week_start half_spread_bps~6 half_spread_source impact_bps_per_unit~8 taker_fee_bps~2 n_days_book n_days_trade"


@query("c9_weekly_cost_table", COST_COLUMNS, f"SELECT * FROM ({WEEKLY_COSTS})")
def _(s, d):
    return C.weekly_cost_table(some_quotes(s, d), daily_impact(s, d, "N"), daily_impact(s, d, "A"))


@query("c10_estimator_agreement", "symbol weeks corr~6 a_median~6 b_median~6 ratio~6", f"""
WITH bk AS (SELECT symbol, day - (isodow(day) - 1)::INTEGER AS week_start, quantile_cont(half_spread_bps, 0.5) AS x FROM ({QUOTED}) GROUP BY 1, 2)
SELECT symbol, weeks, CASE WHEN weeks > 2 THEN c END AS corr, a_median, b_median, CASE WHEN a_median > 0 THEN b_median / a_median END AS ratio FROM (
  SELECT bk.symbol, count(*) AS weeks, corr(x, half_spread_bps) AS c, quantile_cont(x, 0.5) AS a_median, quantile_cont(half_spread_bps, 0.5) AS b_median
  FROM bk JOIN ({AR}) ar ON bk.symbol = ar.symbol AND bk.week_start = ar.week_start GROUP BY 1)""")
def _(s, d):
    weekly = (quoted_daily(s, d).groupBy("symbol", week_start("day").alias("week_start"))
              .agg(F.percentile("half_spread_bps", F.lit(0.5)).alias("half_spread_bps")))
    return C.agreement(weekly, C.range_spread(V.bars(s, d)))


def cost_sample(s, d):
    """(symbol, liquidity, half_spread_bps, depth_1pct_usd) per brand."""
    liq = B.with_dollar_volume(V.bars(s, d)).groupBy("symbol").agg(F.percentile("dollar_volume", F.lit(0.5)).alias("liquidity"))
    spread = quoted_daily(s, d).groupBy("symbol").agg(F.avg("half_spread_bps").alias("half_spread_bps"))
    return liq.join(spread, "symbol").join(C.depth_one_percent(depth_books(s, d)), "symbol", "left")


SAMPLE = f"""SELECT l.symbol, liquidity, half_spread_bps, depth_1pct_usd FROM
  (SELECT symbol, quantile_cont(volume * close, 0.5) AS liquidity FROM bd WHERE volume > 0 GROUP BY 1) l
  JOIN (SELECT symbol, avg(half_spread_bps) AS half_spread_bps FROM ({QUOTED}) GROUP BY 1) q ON l.symbol = q.symbol
  LEFT JOIN ({DEPTH}) d ON l.symbol = d.symbol"""


@query("c5_ladder_fit", "spread_a~6 spread_b~6 depth_a~5 depth_b~6 spread_r2~6 depth_r2~6 spread_miss~6 depth_miss~6 n", f"""
SELECT regr_intercept(y, x) AS spread_a, regr_slope(y, x) AS spread_b, regr_intercept(z, x) AS depth_a, regr_slope(z, x) AS depth_b,
       regr_r2(y, x) AS spread_r2, regr_r2(z, x) AS depth_r2, pow(10, sqrt(var_samp(y) * (1 - regr_r2(y, x)))) AS spread_miss,
       pow(10, sqrt(var_samp(z) * (1 - regr_r2(z, x)))) AS depth_miss, count(*) AS n
FROM (SELECT log10(liquidity) AS x, log10(half_spread_bps) AS y, log10(depth_1pct_usd) AS z FROM ({SAMPLE}) WHERE half_spread_bps > 0)""")
def _(s, d):
    return C.fit_ladder(C.clean_sample(cost_sample(s, d)))


@query("c11_cost_sample", "date band symbol liquidity~4 half_spread_bps~6 depth_1pct_usd~4", f"""
WITH ah AS (SELECT date, min(period) AS period FROM (VALUES (DATE '1997-03-10'), (DATE '1998-03-10'), (DATE '1999-03-10')) v(date) JOIN panel ON period >= date WHERE liquidity IS NOT NULL GROUP BY 1),
lq AS (SELECT ah.date, p.symbol, p.liquidity, CASE WHEN liquidity >= 80000 THEN 0 WHEN liquidity >= 40000 THEN 1 ELSE 2 END AS band
  FROM ah JOIN panel p ON p.period = ah.period WHERE liquidity >= 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY date, band ORDER BY md5(symbol || '|' || (date - DATE '1970-01-01')), symbol) AS n FROM lq),
dp AS ({DEPTH.replace("SELECT symbol, quantile", "SELECT symbol, day, quantile").replace("GROUP BY 1, 2) GROUP BY 1", "GROUP BY 1, 2) GROUP BY 1, 2")})
SELECT dr.date, band, dr.symbol, liquidity, (SELECT avg(q.half_spread_bps) FROM ({QUOTED}) q WHERE q.symbol = dr.symbol AND q.day >= dr.date AND q.day < dr.date + 7) AS half_spread_bps,
  (SELECT avg(depth_1pct_usd) FROM dp WHERE dp.symbol = dr.symbol AND dp.day >= dr.date AND dp.day < dr.date + 7) AS depth_1pct_usd
FROM dr WHERE n <= band + 2""")
def _(s, d):
    p = stored_panel(s, d)
    dates = p.select(F.explode(F.array(*[F.to_date(F.lit(x)) for x in ("1997-03-10", "1998-03-10", "1999-03-10")])).alias("date")).distinct()
    ahead = asof.asof_join(dates, p.filter(F.col("liquidity").isNotNull()), [], "date", "period", {"period": "period"}, direction="forward", block=64 * DAY)
    at = p.select("symbol", "period", "liquidity").join(ahead, "period").filter(F.col("liquidity").isNotNull())
    drawn = C.stratified(at, seed=F.unix_date("date"), by=("date",),
                         bands=((80000.0, float("inf"), 2), (40000.0, 80000.0, 3), (0.0, 40000.0, 4)))
    spread = quoted_daily(s, d).select("symbol", "day", "half_spread_bps")
    depth = C.depth_one_percent(depth_books(s, d), ["symbol", "at"]).withColumnRenamed("at", "day")
    return C.measured_after(C.measured_after(drawn, spread, ["half_spread_bps"]), depth, ["depth_1pct_usd"])


# Books ------------------------------------------------------------------------------------------------------

@query("k1_inverse_vol", "symbol period weight~8", "SELECT symbol, period, weight FROM wt")
def _(s, d):
    return trend_weights(s, d)


@query("k2_gating", "symbol period weight~8", f"""
SELECT symbol, wt.period, CASE WHEN on_ THEN weight ELSE 0 END AS weight FROM wt LEFT JOIN ({UP}) u ON u.period = wt.period""")
def _(s, d):
    p = stored_panel(s, d)
    return K.gated(trend_weights(s, d, p=p), market_up(p))


@query("k3_halt_carry", "symbol period weight~8", "SELECT symbol, period, weight FROM hw")
def _(s, d):
    return K.hold(trend_weights(s, d))


@query("k5_by_bar", "at gross~8 funding~8 cost~8 turnover~8", "SELECT at, gross, funding, cost, turnover FROM bybar_6", ctes=sliced_ctes())
def _(s, d):
    b = stored_long(s, d)
    w = K.inverse_vol(S.trend_sign(P.build(b, min_bars=MIN_BARS), 2), floor=FLOOR)
    return K.by_bar(w, b, FLAT)


GATED_BOOK = {
    "up": UP,
    "gwt": "SELECT wt.* EXCLUDE (weight), CASE WHEN on_ THEN weight ELSE 0 END AS weight FROM wt LEFT JOIN up ON up.period = wt.period",
    "ghw": CTES["hw"].replace("FROM wt", "FROM gwt"), "glegs": CTES["legs"].replace("FROM hw", "FROM ghw"),
    "gbook": CTES["book"].replace("FROM legs", "FROM glegs"),
}


@query("k6_sleeve", "period net~8", """
SELECT period, net + coalesce(lead(ex) OVER (ORDER BY period), 0) AS net, on_ FROM (
  SELECT b.period, net, coalesce(on_, false) AS on_,
         CASE WHEN NOT coalesce(on_, false) AND coalesce(lag(on_) OVER (ORDER BY b.period), false) THEN cost ELSE 0 END AS ex
  FROM gbook b LEFT JOIN up ON up.period = b.period) QUALIFY on_""", ctes=GATED_BOOK)
def _(s, d):
    p = stored_panel(s, d)
    return K.sleeve(trend_weights(s, d, p=p), market_up(p), FLAT)


@query("k7_sliced_book", "period gross~8 funding~8 cost~8 turnover~8", """
SELECT period, gross, funding, cost, turnover FROM (
  SELECT *, min(period) FILTER (gross + funding + cost <> 0) OVER () AS start FROM (
    SELECT at + (7 - isodow(at))::INTEGER AS period, sum(gross) / 7 AS gross, sum(funding) / 7 AS funding, sum(cost) / 7 AS cost, sum(turnover) / 7 AS turnover
    FROM (""" + " UNION ALL ".join(f"SELECT * FROM bybar_{k}" for k in range(7)) + """) GROUP BY 1)) WHERE period >= start""", ctes=sliced_ctes())
def _(s, d):
    b = stored_long(s, d)
    p = P.sliced(b, min_bars=MIN_BARS)
    w = K.inverse_vol(S.trend_sign(p, 2, by=("slice",)), floor=FLOOR, by=("slice",))
    wide = b.withColumn("slice", F.explode(F.array(*[F.lit(k) for k in range(7)])))
    return K.slice_average(K.by_bar(settle(w), wide, FLAT, F.col("slice"), by=("slice",)), 7)


@query("k8_equal_risk", "period r~8", """
SELECT period, (a / sa + b / sb) / 2 AS r FROM (
  SELECT x.t AS period, x.r AS a, y.r AS b, CASE WHEN count(x.r) OVER w >= 26 THEN stddev_samp(x.r) OVER w END AS sa,
         CASE WHEN count(y.r) OVER w >= 26 THEN stddev_samp(y.r) OVER w END AS sb
  FROM books x JOIN books y ON x.t = y.t AND x.book_id = 1 AND y.book_id = 3
  WINDOW w AS (ORDER BY x.t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)) WHERE sa IS NOT NULL AND sb IS NOT NULL""")
def _(s, d):
    b = settle(books(s, d)).withColumnRenamed("t", "period")
    return K.equal_risk(b.filter(F.col("book_id") == 1), b.filter(F.col("book_id") == 3))


@query("k9_gap_contribution", "held_gaps contribution~8 large_gaps", """
SELECT count(*) FILTER (weight <> 0) AS held_gaps, sum(weight * (exp(gap) - 1)) AS contribution, count(*) FILTER (abs(gap) > ln(1.5)) AS large_gaps
FROM hw WHERE gap IS NOT NULL""")
def _(s, d):
    return K.gap_contribution(trend_weights(s, d))


@query("k9_large_gaps", "symbol period gap~8 weight~8 booked~8", """
SELECT symbol, period, gap, weight, weight * (exp(gap) - 1) AS booked FROM hw WHERE abs(gap) > ln(1.05)""")
def _(s, d):
    # Half of the price moves in few gaps of this data, a twentieth in many.
    return K.large_gaps(trend_weights(s, d), beyond=0.05)


@query("r13_exposure", "lookback mean_held~8 share_flat~8 mean_names~8 periods", """
SELECT lookback, avg(g) AS mean_held, avg(CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END) AS share_flat, avg(n) AS mean_names, count(*) AS periods FROM (
  SELECT *, min(period) FILTER (g > 0) OVER (PARTITION BY lookback) AS start FROM (
    SELECT lookback, period, sum(abs(weight)) AS g, count(*) FILTER (weight <> 0) AS n FROM lhw GROUP BY 1, 2)) WHERE period >= start GROUP BY 1""")
def _(s, d):
    return K.exposure(sweep_weights(s, d), by=("lookback",))


@query("o4_trim_idle", "period turnover~8", """
SELECT period, turnover FROM (SELECT *, min(period) FILTER (turnover > 0) OVER () AS start FROM (
  SELECT period, sum(dw) AS turnover FROM legs GROUP BY 1)) WHERE period >= start""")
def _(s, d):
    dw = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(P.own()), F.lit(0.0)))
    t = K.hold(trend_weights(s, d)).withColumn("dw", dw).groupBy("period").agg(F.sum("dw").alias("turnover"))
    return K.trim_idle(t, F.col("turnover") > 0, ())


@query("j9_parameter_grid", "lookback period gross~8 cost~8 net~8", "SELECT lookback, period, gross, cost, net FROM lbook")
def _(s, d):
    return K.run(sweep_weights(s, d), FLAT, by=("lookback",))


# Signals ----------------------------------------------------------------------------------------------------

@query("gt1_trend_sign", "symbol period signal~1", "SELECT symbol, period, signal FROM sig")
def _(s, d):
    return S.trend_sign(panel(s, d), 2)


BASKET = f"""SELECT symbol, period, raw / sum(abs(raw)) OVER (PARTITION BY period) AS weight FROM (
  SELECT *, CASE WHEN liquidity >= {FLOOR} AND vol > 0 AND lag(returns) OVER (PARTITION BY symbol ORDER BY period) IS NOT NULL THEN 1 / vol END AS raw FROM panel)"""


@query("gt2_market_book", "symbol period weight~8", f"""
SELECT b.symbol, b.period, b.weight * timing AS weight FROM ({BASKET}) b LEFT JOIN (
  SELECT period, lag(sg) OVER (ORDER BY period) AS timing FROM (
    SELECT period, CASE WHEN count(market) OVER w = 2 THEN sign(sum(market) OVER w) END AS sg FROM wmarket
    WINDOW w AS (ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))) t ON t.period = b.period""")
def _(s, d):
    return S.market_book(stored_panel(s, d), 2, FLOOR)


LINES = """SELECT symbol, at, bar, CASE WHEN n >= 20 THEN trail END AS trail, CASE WHEN n >= 20 AND m = 28 AND v > 0 THEN c END AS corr,
  CASE WHEN n >= 20 AND m = 28 THEN sl END AS slope FROM (
  SELECT *, count(returns) OVER r AS n, count(*) OVER r AS m, sum(returns) OVER r AS trail, var_samp(lvl) OVER r AS v,
         corr(lvl, bar) OVER r AS c, regr_slope(lvl, bar) OVER r AS sl FROM (
    SELECT *, sum(coalesce(returns, 0)) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS lvl FROM g0)
  WINDOW r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))"""


def fitted(s, d, b=None):
    return S.lines(G.bar_grid((b if b is not None else long_bars(s, d)).select("symbol", "at", "bar", "returns")), 28)


@query("gt3_trailing_line", "symbol at trail~8 corr~6 slope~8", f"SELECT symbol, at, trail, corr, slope FROM ({LINES})")
def _(s, d):
    return fitted(s, d)


@query("gt4_steepness_and_fit", "symbol period sign~1 direction~1 z~6 r2~6", f"""
WITH c AS (SELECT symbol AS sy, at + (7 - isodow(at))::INTEGER AS pe, arg_max(trail, at) FILTER (trail IS NOT NULL) AS trail,
  arg_max(slope, at) FILTER (slope IS NOT NULL) AS slope, arg_max(corr, at) FILTER (corr IS NOT NULL) AS corr FROM ({LINES}) GROUP BY 1, 2)
SELECT symbol, period, sign(trail) AS sign, sign(slope) AS direction,
  CASE WHEN lead(liquidity) OVER w >= {FLOOR} AND lead(vol) OVER w IS NOT NULL AND trail IS NOT NULL THEN abs(slope) * 28 / (lead(vol) OVER w * 2) END AS z,
  corr * corr AS r2 FROM panel LEFT JOIN c ON sy = symbol AND pe = period WINDOW w AS (PARTITION BY symbol ORDER BY period)""")
def _(s, d):
    b = stored_long(s, d)
    closes = P.at_close(fitted(s, d, b), ["trail", "slope", "corr"])
    return S.line_parts(P.build(b, min_bars=MIN_BARS), closes, 28, 7, FLOOR)


@query("gt5_clock_fit", "symbol open_time corr~5", """
WITH h AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS open_time, arg_max(price, ts) AS close FROM trades GROUP BY 1, 2),
r AS (SELECT x.symbol, x.open_time, h.close FROM (
  SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 HOUR)) AS open_time FROM h GROUP BY 1) x
  LEFT JOIN h ON h.symbol = x.symbol AND h.open_time = x.open_time),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i, ln(close) AS y FROM r)
SELECT symbol, open_time, CASE WHEN n_ >= 24 * 5 * 5.0 / 7 AND i >= 120 AND vy > 0 THEN c END AS corr FROM (
  SELECT symbol, open_time, i, count(y) OVER w AS n_, corr(y, i) OVER w AS c, var_samp(y) OVER w AS vy FROM n
  WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))""")
def _(s, d):
    h = settle(B.ohlcv(V.trades(s, d), "1 hour").select("symbol", "open_time", "close"))
    return S.clock_fit(G.regular(h, ["symbol"], "open_time"), 5)


@query("gt6_breakout", "symbol period signal~1", """
SELECT symbol, period, CASE WHEN n = 3 AND lvl <= lo THEN -1.0 WHEN n = 3 AND lvl >= hi THEN 1.0 ELSE 0.0 END AS signal FROM (
  SELECT *, count(lvl) OVER r AS n, min(lvl) OVER r AS lo, max(lvl) OVER r AS hi FROM (
    SELECT *, CASE WHEN returns IS NOT NULL THEN sum(returns) OVER (PARTITION BY symbol ORDER BY period ROWS UNBOUNDED PRECEDING) END AS lvl FROM panel)
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""")
def _(s, d):
    return S.breakout(panel(s, d), 3)


@query("gt7_efficiency_thirds", "symbol period er~8 third", f"""
WITH e AS (SELECT *, CASE WHEN count(returns) OVER r = 2 THEN abs(sum(returns) OVER r) / sum(abs(returns)) OVER r END AS er FROM panel
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN liquidity >= {FLOOR} AND vol > 0 THEN er END AS x FROM e)
SELECT symbol, v.period, er, CASE WHEN x <= lo THEN 0 WHEN x >= hi THEN 2 WHEN x IS NOT NULL THEN 1 END::BIGINT AS third
FROM v JOIN (SELECT period, quantile_cont(x, 1.0::DOUBLE / 3) AS lo, quantile_cont(x, 2.0::DOUBLE / 3) AS hi FROM v GROUP BY 1) q ON q.period = v.period""")
def _(s, d):
    e = S.efficiency(panel(s, d), 2)
    return S.cross_thirds(e, "er", (F.col("liquidity") >= FLOOR) & (F.col("vol") > 0))


@query("gt8_residual_momentum", "symbol period own~8 mkt~8 resid~8", """
SELECT o.symbol, o.period, own, mkt, own - mkt AS resid FROM (
  SELECT symbol, period, CASE WHEN count(returns) OVER r = 2 THEN sum(returns) OVER r END AS own FROM panel
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) o
LEFT JOIN (SELECT period, CASE WHEN count(market) OVER r = 2 THEN sum(market) OVER r END AS mkt FROM wmarket
  WINDOW r AS (ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) m ON m.period = o.period""")
def _(s, d):
    return S.residual_momentum(stored_panel(s, d), 2, FLOOR)


@query("gt9_funding_aware", "symbol period signal~1", """
SELECT symbol, period, CASE WHEN count(returns) OVER r = 2 THEN sign(sum(returns) OVER r - sum(funding) OVER r) END AS signal FROM panel
WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    return S.funding_aware(panel(s, d), 2)


MK = {"mk": f"SELECT b.period, ln(1 + sum(coalesce(b.weight, 0) * coalesce(p.pnl, 0))) AS mk FROM ({BASKET}) b JOIN panel p ON p.symbol = b.symbol AND p.period = b.period GROUP BY 1",
      "beta": """SELECT symbol, period, lag(cv / mv) OVER (PARTITION BY symbol ORDER BY period) AS beta FROM (
  SELECT symbol, p.period, m.mv, CASE WHEN count(CASE WHEN returns IS NOT NULL THEN mk END) OVER r >= 13 THEN covar_samp(returns, mk) OVER r END AS cv
  FROM panel p JOIN (SELECT *, CASE WHEN count(mk) OVER w >= 13 THEN var_samp(mk) OVER w END AS mv FROM mk
    WINDOW w AS (ORDER BY period ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)) m ON m.period = p.period
  WINDOW r AS (PARTITION BY symbol ORDER BY p.period ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))"""}


def with_beta(s, d):
    p = stored_panel(s, d)
    b = S.basket(p, FLOOR, name="base")
    mk = b.groupBy("period").agg(F.log(1 + F.sum(F.coalesce("base", F.lit(0.0)) * F.coalesce("pnl", F.lit(0.0)))).alias("mk"))
    return S.rolling_beta(b, mk)


@query("gt10_rolling_beta", "symbol period beta~6", "SELECT symbol, period, beta FROM beta", ctes=MK)
def _(s, d):
    return with_beta(s, d)


@query("gt10_beta_neutral", "symbol period market_part~6 rest~6 neutral~6 capped~6", f"""
SELECT symbol, period, market_part, rest, rest - base * nb AS neutral, capped FROM (
  SELECT *, sum(rest * beta) OVER (PARTITION BY period) AS nb FROM (
    SELECT *, base * sum(w) OVER (PARTITION BY period) AS market_part, w - base * sum(w) OVER (PARTITION BY period) AS rest FROM (
      SELECT wt.symbol, wt.period, coalesce(wt.weight, 0) AS w, coalesce(b.weight, 0) AS base, beta,
             CASE WHEN wt.returns IS NOT NULL THEN exp(greatest(-2, least(2, wt.returns / nullif(wt.vol, 0))) * wt.vol
                  + CASE WHEN wt.vol IS NULL THEN NULL ELSE 0 END) - 1 ELSE wt.pnl END AS capped
      FROM wt JOIN ({BASKET}) b ON b.symbol = wt.symbol AND b.period = wt.period JOIN beta ON beta.symbol = wt.symbol AND beta.period = wt.period)))""", ctes=MK)
def _(s, d):
    w = K.inverse_vol(S.trend_sign(with_beta(s, d), 2), floor=FLOOR)
    return S.beta_neutral(w, "base").withColumn("capped", S.capped_move())


@query("gt11_zscore", "symbol period z~6", f"""
SELECT symbol, v.period, (x - m) / nullif(sd, 0) AS z FROM (SELECT *, CASE WHEN liquidity >= {FLOOR} THEN returns END AS x FROM panel) v
JOIN (SELECT period, avg(x) AS m, stddev_samp(x) AS sd FROM (SELECT period, CASE WHEN liquidity >= {FLOOR} THEN returns END AS x FROM panel) GROUP BY 1) q ON q.period = v.period""")
def _(s, d):
    return S.zscore(panel(s, d), "returns", F.col("liquidity") >= FLOOR)


@query("gt12_oi_features", "period growth~6 level~6", """
WITH x AS (SELECT symbol, period, ln(liquidity) - CASE WHEN returns IS NOT NULL THEN sum(returns) OVER (PARTITION BY symbol ORDER BY period ROWS UNBOUNDED PRECEDING) END AS c FROM panel),
y AS (SELECT symbol, period, c - lag(c, 2) OVER (PARTITION BY symbol ORDER BY period) AS gr, c - CASE WHEN count(c) OVER r >= 5 THEN avg(c) OVER r END AS dv FROM x
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
SELECT period, lag(gr) OVER (ORDER BY period) AS growth, lag(dv) OVER (ORDER BY period) AS level FROM (SELECT period, avg(gr) AS gr, avg(dv) AS dv FROM y GROUP BY 1)""")
def _(s, d):
    return S.oi_features(panel(s, d).withColumn("oi_value", F.col("liquidity")), 2, 26, 5)


CLOSES = """(SELECT s.symbol, s.period, c.close, coalesce(p.funding, 0) AS funding FROM spine s JOIN panel p ON p.symbol = s.symbol AND p.period = s.period LEFT JOIN (
  SELECT symbol, at + (7 - isodow(at))::INTEGER AS period, arg_max(close, at) AS close FROM bd GROUP BY 1, 2) c ON c.symbol = s.symbol AND c.period = s.period)"""


def closes(s, d):
    b = stored_long(s, d)
    return P.build(b, min_bars=MIN_BARS).select("symbol", "period", "funding").join(P.at_close(b, ["close"]), ["symbol", "period"], "left")


@query("gt13_vol_scaled_long", "period plain~8 scaled~8", f"""
WITH r AS (SELECT symbol, period, close / lag(close) OVER w - 1 AS r FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY period)),
k AS (SELECT symbol, period, lead(r) OVER w AS f, CASE WHEN count(r) OVER q >= 8 THEN least(0.01 / nullif(stddev_samp(r) OVER q, 0), 3.0) END AS k FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY period), q AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
l AS (SELECT symbol, period, f, lag(k) OVER (PARTITION BY symbol ORDER BY period) AS k FROM k)
SELECT period, avg(f) AS plain, avg(f * k) AS scaled FROM l GROUP BY 1 HAVING avg(f) IS NOT NULL""")
def _(s, d):
    return S.vol_scaled_long(closes(s, d))


@query("gt14_flip_book", "symbol period gross~8 paid~8 flip~1 net~8", f"""
SELECT symbol, period, sig * fwd AS gross, -sig * funding AS paid, flip, sig * fwd - sig * funding - flip * 0.001 AS net FROM (
  SELECT *, CASE WHEN lag(sig) OVER w IS NULL OR lag(sig) OVER w <> sig THEN 1.0 ELSE 0.0 END AS flip FROM (
    SELECT *, sign(close / lag(close, 2) OVER w - 1) AS sig, lead(close) OVER w / close - 1 AS fwd FROM {CLOSES} WINDOW w AS (PARTITION BY symbol ORDER BY period))
  WHERE sig IS NOT NULL AND fwd IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY period))""")
def _(s, d):
    return S.flip_book(closes(s, d), 2)


@query("gt15_placebo_signs", "run symbol period signal~1", """
SELECT run, symbol, period, CASE WHEN live THEN CASE WHEN ('0x' || substr(md5(symbol || '|' || period || '|' || run || '|0'), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END END AS signal
FROM (SELECT *, lag(returns) OVER (PARTITION BY symbol ORDER BY period) IS NOT NULL AS live FROM panel), range(1, 21) r(run)""")
def _(s, d):
    return S.placebo(panel(s, d))


@query("gt15_placebo", "run periods sharpe~6")
def _(s, d):
    from ..functions import moments as M
    w = K.inverse_vol(S.placebo(panel(s, d)), floor=FLOOR, by=("run",))
    return K.run(w, FLAT, by=("run",)).groupBy("run").agg(F.count("net").alias("periods"), M.sharpe("net", 52).alias("sharpe"))


@query("gt16_index_paths", "period equal_path~8 volume_weighted_path~8 single_path~8", f"""
SELECT period, sum(e) OVER w AS equal_path, sum(v) OVER w AS volume_weighted_path, sum(s) OVER w AS single_path FROM (
  SELECT period, avg(r) AS e, sum(r * liquidity) / nullif(sum(CASE WHEN r IS NOT NULL THEN liquidity END), 0) AS v, max(CASE WHEN symbol = 'Brand#11' THEN returns END) AS s
  FROM (SELECT *, CASE WHEN liquidity >= {FLOOR} THEN returns END AS r FROM panel) GROUP BY 1) WHERE e IS NOT NULL AND v IS NOT NULL AND s IS NOT NULL
WINDOW w AS (ORDER BY period ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    return S.index_paths(panel(s, d), FLOOR, "Brand#11")


@query("gt17_band", "symbol period signal~6", "SELECT symbol, period, CASE WHEN count(signal) = 3 THEN sum(signal) / 3 END AS signal FROM lsig WHERE lookback <= 3 GROUP BY 1, 2")
def _(s, d):
    return S.band(panel(s, d), (1, 2, 3))


@query("gt18_legs", "period long_leg~8 short_leg~8", "SELECT period, sum(greatest(weight, 0)) AS long_leg, sum(least(weight, 0)) AS short_leg FROM hw GROUP BY 1")
def _(s, d):
    from ..functions.columns import clip
    h = K.hold(trend_weights(s, d))
    return h.groupBy("period").agg(F.sum(clip("weight", lo=0.0)).alias("long_leg"), F.sum(clip("weight", hi=0.0)).alias("short_leg"))


@query("gt19_vol_scaled_returns", "symbol raw~8 scaled~8", f"""
SELECT symbol, stddev_samp(CASE WHEN liquidity >= {FLOOR} THEN returns END) AS raw, stddev_samp(CASE WHEN liquidity >= {FLOOR} THEN returns / nullif(vol, 0) END) AS scaled FROM panel GROUP BY 1""")
def _(s, d):
    from ..functions.columns import div
    r = F.when(F.col("liquidity") >= FLOOR, F.col("returns"))
    return panel(s, d).groupBy("symbol").agg(F.stddev_samp(r).alias("raw"), F.stddev_samp(div(r, F.col("vol"))).alias("scaled"))
