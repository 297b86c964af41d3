"""Queries for joins, aggregates, windows, sorting and set operations as the library uses them (J, A, W, O, U)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import DAY, HOUR, corr, rolling
from ..operators import asof, bars as B, book as K, costs as C, events as E, panel as P, signals as S, stats as R
from ..session import settle
from . import views as V
from .bars_and_panel import long_bars, panel, stored_panel
from .books_and_signals import SAMPLE, books, cost_sample
from .events_and_ledger import EV, EXITS, setup, stored_candidates
from .oracle_views import FLOOR
from .registry import query


@query("j1_equi_joins", "symbol at close~6 funding_rate~10", """
SELECT coalesce(bd.symbol, p.symbol) AS symbol, coalesce(bd.at, p.t) AS at, close, funding_rate FROM bd FULL JOIN prints p ON p.symbol = bd.symbol AND p.t = bd.at""")
def _(s, d):
    return V.bars(s, d).join(V.prints(s, d).withColumnRenamed("t", "at"), ["symbol", "at"], "full_outer")


@query("j2_asof_forward", "symbol t paid_on", "SELECT p.symbol, p.t, b.at AS paid_on FROM prints p ASOF LEFT JOIN bd b ON b.symbol = p.symbol AND b.at >= p.t")
def _(s, d):
    return asof.asof_join(V.prints(s, d), V.bars(s, d), ["symbol"], "t", "at", {"paid_on": "at"}, direction="forward", block=64 * DAY)


@query("j3_asof_backward", "order_id week_start half_spread_bps~6", """
SELECT order_id, week_start, half_spread_bps FROM ord o ASOF LEFT JOIN cost_rows c ON c.symbol = o.symbol AND c.week_start <= o.t""")
def _(s, d):
    return asof.asof_join(V.orders(s, d), V.cost_rows(s, d), ["symbol"], "t", "week_start",
                          {"week_start": "week_start", "half_spread_bps": "half_spread_bps"}, block=64 * DAY)


@query("j4_last_trade_mark", "event_id mark~6", """
SELECT e.event_id, t.price AS mark FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN trades t ON t.symbol = e.user_id::VARCHAR AND t.ts < e.ts""")
def _(s, d):
    errors = V.table(s, d, "events").filter(F.col("event_type") == "error").select("event_id", F.col("user_id").cast("string").alias("symbol"), "ts")
    return asof.asof_join(errors, V.trades(s, d), ["symbol"], "ts", "ts", {"mark": "price"}, block=6 * HOUR, strict=True, right_tie=F.col("id"))


@query("j5_range_as_equi", "trade i move~8", """
SELECT en.trade, b.i, en.side * (b.level - entry_level) AS move FROM en JOIN lv b ON b.symbol = en.symbol AND b.i > e AND b.i <= e + 5""", ctes=EV)
def _(s, d):
    lv, tr = setup(s, d)
    e = E.opened(lv, tr, EXITS).select("trade", "symbol", "side", "base", F.explode(F.sequence(F.col("e") + 1, F.col("e") + EXITS.horizon)).alias("i"))
    return e.join(lv.select("symbol", F.col("n").alias("i"), "cum"), ["symbol", "i"]).withColumn("move", F.col("side") * (F.col("cum") - F.col("base")))


@query("j6_ordinal_offset", "trade fill_at", "SELECT t.trade, f.at AS fill_at FROM tr t JOIN lv b ON b.symbol = t.symbol AND b.at = t.at JOIN lv f ON f.symbol = b.symbol AND f.i = b.i + 2", ctes=EV)
def _(s, d):
    lv, tr = setup(s, d)
    i = tr.join(lv.select("symbol", "at", "n"), ["symbol", "at"]).withColumn("n", F.col("n") + 2)
    return i.drop("at").join(lv.select("symbol", "n", F.col("at").alias("fill_at")), ["symbol", "n"])


@query("j7_semi_anti", "p_partkey seen", """
SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS seen FROM part""")
def _(s, d):
    p = V.table(s, d, "part").select("p_partkey")
    r = V.table(s, d, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    yes, no = p.join(r, "p_partkey", "left_semi"), p.join(r, "p_partkey", "left_anti")
    return yes.withColumn("seen", F.lit(True)).unionByName(no.withColumn("seen", F.lit(False)))


@query("j8_hedge_join", "symbol at spread~8", """
SELECT a.symbol, a.at, ln(a.close) - last_value(ln(h.close) IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.at ROWS UNBOUNDED PRECEDING) AS spread
FROM bd a LEFT JOIN (SELECT at, close FROM bd WHERE symbol = 'Brand#22') h ON h.at = a.at WHERE a.symbol <> 'Brand#22'""")
def _(s, d):
    b = V.stored_bars(s, d)
    h = b.filter(F.col("symbol") == "Brand#22").select("at", F.log("close").alias("h"))
    j = b.filter(F.col("symbol") != "Brand#22").join(h, "at", "left")
    return j.withColumn("spread", F.log("close") - F.last("h", ignorenulls=True).over(B.upto()))


@query("j10_pairwise_correlation", "year names avg_corr~6", """
WITH r AS (SELECT symbol, period, year(period) AS y, pnl AS x FROM panel),
m AS (SELECT y, symbol FROM r GROUP BY 1, 2 HAVING count(x) >= floor(0.5 * (SELECT count(DISTINCT period) FROM r r2 WHERE r2.y = r.y)) AND stddev_pop(x) > 0),
z AS (SELECT r.* FROM r JOIN m ON m.y = r.y AND m.symbol = r.symbol WHERE x IS NOT NULL),
c AS (SELECT a.y, a.symbol AS i, b.symbol AS j, CASE WHEN a.symbol = b.symbol THEN 1.0 WHEN count(*) > 1 AND stddev_pop(a.x) > 1e-9 * max(abs(a.x)) AND stddev_pop(b.x) > 1e-9 * max(abs(b.x)) THEN corr(a.x, b.x) ELSE 0.0 END AS c
  FROM z a JOIN z b ON a.y = b.y AND a.period = b.period GROUP BY 1, 2, 3)
SELECT c.y AS year, any_value(k) AS names, (sum(c.c) - any_value(k)) / (any_value(k) * (any_value(k) - 1)) AS avg_corr FROM c JOIN (SELECT y, count(*) AS k FROM m GROUP BY 1) n ON n.y = c.y GROUP BY 1""")
def _(s, d):
    rows = settle(panel(s, d).select("symbol", "period", F.col("pnl").alias("returns")))
    return R.correlation_structure(rows, share=0.5).select("year", "names", "avg_corr")


@query("a1_group_aggregates", "symbol n total~4 mean~6 lo~6 hi~6", "SELECT symbol, count(*) AS n, sum(volume) AS total, avg(close) AS mean, min(low) AS lo, max(high) AS hi FROM bd GROUP BY 1")
def _(s, d):
    return V.bars(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("total"), F.avg("close").alias("mean"),
                                             F.min("low").alias("lo"), F.max("high").alias("hi"))


@query("a2_sum_with_min_count", "symbol year total~8", "SELECT symbol, year(at) AS year, CASE WHEN count(returns) >= 80 THEN sum(returns) END AS total FROM lb GROUP BY 1, 2")
def _(s, d):
    from ..functions.columns import at_least
    return long_bars(s, d).groupBy("symbol", F.year("at").alias("year")).agg(at_least(80, F.sum("returns"), F.count("returns")).alias("total"))


@query("a3_first_last", "symbol first_close~6 last_close~6", "SELECT symbol, arg_min(close, at) AS first_close, arg_max(close, at) AS last_close FROM bd GROUP BY 1")
def _(s, d):
    return V.bars(s, d).groupBy("symbol").agg(F.min_by("close", "at").alias("first_close"), F.max_by("close", "at").alias("last_close"))


@query("a4_cross_section_quantiles", "at lo~6 mid~6 hi~6", """
SELECT at, quantile_cont(close, 0.1) AS lo, quantile_cont(close, 0.5) AS mid, quantile_cont(close, 0.9) AS hi FROM bd GROUP BY 1""")
def _(s, d):
    q = F.percentile("close", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return V.bars(s, d).groupBy("at").agg(q.alias("q")).select("at", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))


@query("a5_moments", "symbol var_s~6 var_p~6 skew~5 kurt~5", """
SELECT symbol, var_samp(close / 1000) AS var_s, var_pop(close / 1000) AS var_p, any_value(m3) / pow(var_pop(close / 1000), 1.5) AS skew, kurtosis_pop(close / 1000) + 3 AS kurt FROM bd JOIN (
  SELECT symbol AS s2, avg(pow(close / 1000 - m, 3)) AS m3 FROM bd JOIN (SELECT symbol AS s1, avg(close / 1000) AS m FROM bd GROUP BY 1) ON s1 = symbol GROUP BY 1) ON s2 = symbol GROUP BY 1""")
def _(s, d):
    from ..functions.moments import raw_kurtosis
    b = V.bars(s, d).withColumn("x", F.col("close") / 1000)
    return b.groupBy("symbol").agg(F.var_samp("x").alias("var_s"), F.var_pop("x").alias("var_p"), F.skewness("x").alias("skew"), raw_kurtosis("x").alias("kurt"))


@query("a6_rolling_regression", "symbol at corr~5 slope~6", """
SELECT symbol, at, CASE WHEN count(*) OVER r >= 10 THEN corr(close, volume) OVER r END AS corr, CASE WHEN count(*) OVER r >= 10 THEN covar_samp(close, volume) OVER r / nullif(var_samp(volume) OVER r, 0) END AS slope
FROM (SELECT symbol, at, close / 1000 AS close, volume FROM bd) WINDOW r AS (PARTITION BY symbol ORDER BY at ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    from ..functions.columns import div
    w = Window.partitionBy("symbol").orderBy("at").rowsBetween(-19, 0)
    enough = F.count(F.lit(1)).over(w) >= 10
    b = V.bars(s, d).withColumn("close", F.col("close") / 1000)
    slope = div(F.covar_samp("close", "volume").over(w), F.var_samp("volume").over(w))
    return b.withColumn("corr", F.when(enough, corr("close", "volume", w))).withColumn("slope", F.when(enough, slope))


@query("a7_loglog_line", "a~5 b~6 r2~6", """
SELECT regr_intercept(ln(volume), ln(close)) AS a, regr_slope(ln(volume), ln(close)) AS b, regr_r2(ln(volume), ln(close)) AS r2 FROM bd WHERE volume > 0""")
def _(s, d):
    x, y = F.log("close"), F.log("volume")
    return V.bars(s, d).filter(F.col("volume") > 0).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"))


@query("a8_distinct", "symbol days keys", "SELECT p_brand AS symbol, count(DISTINCT l_shipdate) AS days, count(DISTINCT l_orderkey) AS keys FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(s, d):
    l = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey")
    j = l.join(V.table(s, d, "part").select("p_partkey", F.col("p_brand").alias("symbol")), "p_partkey")
    return j.groupBy("symbol").agg(F.count_distinct("l_shipdate").alias("days"), F.count_distinct("l_orderkey").alias("keys"))


@query("a9_histogram", "bin n", """
SELECT least(greatest(floor((x + 2) / 0.05), 0), 79)::BIGINT AS bin, count(*) AS n FROM (SELECT round(returns, 6) + 0.0000003 AS x FROM lb WHERE returns IS NOT NULL) GROUP BY 1""")
def _(s, d):
    # Off the bin edges, where equal returns could fall either way.
    b = long_bars(s, d).select((F.round("returns", 6) + F.lit(0.0000003)).alias("x"))
    return R.histogram(b, "x", -2.0, 2.0, 80)


@query("a10_pivot_unpivot", "at symbol close~6", "SELECT at, symbol, close FROM bd")
def _(s, d):
    names = [r[0] for r in V.table(s, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    wide = V.bars(s, d).groupBy("at").pivot("symbol", names).agg(F.first("close"))
    return wide.unpivot(["at"], [f"`{n}`" for n in names], "symbol", "close").filter(F.col("close").isNotNull())


@query("a11_by_year", "symbol year n mean~6", "SELECT symbol, year(at) AS year, count(*) AS n, avg(close) AS mean FROM bd GROUP BY 1, 2")
def _(s, d):
    return V.bars(s, d).groupBy("symbol", F.year("at").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"))


BY_SYMBOL = "(PARTITION BY symbol ORDER BY at{})"


@query("w1_lag_lead", "symbol at before~6 after~6", "SELECT symbol, at, lag(close) OVER w AS before, lead(close, 2) OVER w AS after FROM bd WINDOW w AS (PARTITION BY symbol ORDER BY at)")
def _(s, d):
    return V.bars(s, d).withColumn("before", F.lag("close").over(B.own())).withColumn("after", F.lead("close", 2).over(B.own()))


@query("w2_fill", "symbol at forward~6 backward~6", """
SELECT symbol, at, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY at ROWS UNBOUNDED PRECEDING) AS forward,
  first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM (SELECT *, CASE WHEN volume > 0 THEN close END AS c FROM bd)""")
def _(s, d):
    c = V.bars(s, d).withColumn("c", F.when(F.col("volume") > 0, F.col("close")))
    back = Window.partitionBy("symbol").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("forward", F.last("c", ignorenulls=True).over(B.upto())).withColumn("backward", F.last("c", ignorenulls=True).over(back))


@query("w3_running", "symbol at total~4 peak~6 later_peak~6", """
SELECT symbol, at, sum(volume) OVER w AS total, max(close) OVER w AS peak, max(close) OVER (PARTITION BY symbol ORDER BY at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later_peak
FROM bd WINDOW w AS (PARTITION BY symbol ORDER BY at ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    back = Window.partitionBy("symbol").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    b = V.bars(s, d)
    return b.withColumn("total", F.sum("volume").over(B.upto())).withColumn("peak", F.max("close").over(B.upto())).withColumn("later_peak", F.max("close").over(back))


@query("w4_rolling_rows", "symbol at mean~6", """
SELECT symbol, at, CASE WHEN count(c) OVER w >= 3 THEN avg(c) OVER w END AS mean FROM (SELECT *, CASE WHEN volume > 0 THEN close END AS c FROM bd) WINDOW w AS (PARTITION BY symbol ORDER BY at ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    c = V.bars(s, d).withColumn("c", F.when(F.col("volume") > 0, F.col("close")))
    return c.withColumn("mean", rolling(F.avg, F.col("c"), B.own().rowsBetween(-6, 0), 3))


@query("w5_rolling_time", "symbol at total~4", "SELECT symbol, at, sum(volume) OVER (PARTITION BY symbol ORDER BY at RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS total FROM bd")
def _(s, d):
    b = V.bars(s, d)
    return b.withColumn("total", F.sum("volume").over(B._span(b, "at", 7 * DAY)))


@query("w6_expanding_quantile", "period q~8", """
SELECT period, CASE WHEN count(market) OVER w >= 10 THEN quantile_cont(market, 0.5) OVER w END AS q FROM wmarket WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(s, d):
    from ..operators.conditions import past_quantiles
    return past_quantiles(P.market_return(panel(s, d), FLOOR), "market", {"q": 0.5}, 10)


@query("w7_ranks", "symbol at dense num average~1", """
SELECT symbol, at, dense_rank() OVER (PARTITION BY symbol ORDER BY volume) AS dense, row_number() OVER (PARTITION BY symbol ORDER BY volume, at) AS num,
  rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS average FROM bd""")
def _(s, d):
    w = Window.partitionBy("symbol")
    return (V.bars(s, d).withColumn("dense", F.dense_rank().over(w.orderBy("volume"))).withColumn("num", F.row_number().over(w.orderBy("volume", "at")))
            .withColumn("average", R.average_rank("volume", ["symbol"])))


@query("w8_ordinal", "symbol at i", "SELECT symbol, at, row_number() OVER (PARTITION BY symbol ORDER BY at) - 1 AS i FROM bd")
def _(s, d):
    return V.bars(s, d).withColumn("i", F.row_number().over(B.own()) - 1)


@query("o1_walk_order", "trade rank", """
SELECT trade, row_number() OVER (PARTITION BY entry ORDER BY -abs(strength), trade) AS rank FROM cand""", ctes=EV)
def _(s, d):
    _lv, c = stored_candidates(s, d)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy(-F.abs("strength"), "trade")))


@query("o2_best_per_group", "symbol at close~6", "SELECT symbol, arg_max(at, (close, -epoch(at))) AS at, max(close) AS close FROM bd GROUP BY 1")
def _(s, d):
    best = F.max_by(F.struct("at", "close"), F.struct(F.col("close"), -F.unix_date("at")))
    return V.bars(s, d).groupBy("symbol").agg(best.alias("b")).select("symbol", "b.at", "b.close")


@query("o3_stratified_draw", "band symbol liquidity~4", f"""
SELECT band, symbol, liquidity FROM (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(symbol || '|7'), symbol) AS n FROM (
    SELECT symbol, liquidity, CASE WHEN liquidity >= 80000 THEN 0 WHEN liquidity >= 40000 THEN 1 WHEN liquidity >= 0 THEN 2 END AS band FROM ({SAMPLE})) WHERE band IS NOT NULL)
WHERE n <= band + 2""")
def _(s, d):
    bands = ((80000.0, float("inf"), 2), (40000.0, 80000.0, 3), (0.0, 40000.0, 4))
    return C.stratified(cost_sample(s, d).select("symbol", "liquidity"), 7, bands=bands)


@query("u1_union_all", "kind symbol at x~8", """
SELECT 'bar' AS kind, symbol, at, close / 1000 AS x FROM bd UNION ALL SELECT 'print', symbol, t, funding_rate FROM prints""")
def _(s, d):
    b = V.bars(s, d).select(F.lit("bar").alias("kind"), "symbol", "at", (F.col("close") / 1000).alias("x"))
    return b.unionByName(V.prints(s, d).select(F.lit("print").alias("kind"), "symbol", F.col("t").alias("at"), F.col("funding_rate").alias("x")))


@query("u2_set_operations", "side symbol at", """
SELECT 'bars only' AS side, symbol, at FROM (SELECT symbol, at FROM bd EXCEPT SELECT symbol, t FROM prints)
UNION ALL SELECT 'both', symbol, at FROM (SELECT symbol, at FROM bd INTERSECT SELECT symbol, t FROM prints)""")
def _(s, d):
    b, p = V.stored_bars(s, d).select("symbol", "at"), settle(V.prints(s, d).select("symbol", F.col("t").alias("at")))
    only, both = b.join(p, ["symbol", "at"], "left_anti"), b.join(p, ["symbol", "at"], "left_semi")
    return only.withColumn("side", F.lit("bars only")).unionByName(both.withColumn("side", F.lit("both")))
