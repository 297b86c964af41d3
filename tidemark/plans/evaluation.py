"""Queries for conditions, statistics, the gate and the trial ledger (M, R, G)."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import moments as M_
from ..functions.columns import div
from ..operators import book as K, conditions as M, gate as Gt, panel as P, signals as S, stats as R, trials as Tr
from ..session import settle, shared_dir
from . import views as V
from .bars_and_panel import net_series, panel, stored_panel, trend_weights
from .books_and_signals import BASKET, FLAT, books, market_up
from .oracle_views import CTES, FLOOR, LOOKBACKS
from .registry import query

# Conditions -------------------------------------------------------------------------------------------------

STRENGTH = """SELECT period, lag(x) OVER (ORDER BY period) AS strength FROM (
  SELECT period, CASE WHEN count(market) OVER a = 4 THEN abs(sum(market) OVER a) END
    / nullif(CASE WHEN count(market) OVER b >= 8 THEN stddev_samp(market) OVER b END * 2, 0) AS x FROM wmarket
  WINDOW a AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def stored_market(s, d):
    return settle(P.market_return(panel(s, d), FLOOR))


@query("m1_market_strength", "period strength~6", STRENGTH)
def _(s, d):
    return M.strength(P.market_return(panel(s, d), FLOOR))


@query("m2_comovement", "period comove~6", f"""
WITH z AS (SELECT symbol, period, CASE WHEN liquidity >= 0 THEN returns END / nullif(vol, 0) AS z FROM panel),
p AS (SELECT DISTINCT period FROM panel),
win AS (SELECT p.period AS pe, z.symbol, z.period AS q, z.z FROM p JOIN z ON z.period < p.period AND z.period >= p.period - 84 AND z.z IS NOT NULL),
ok AS (SELECT pe, symbol FROM win GROUP BY 1, 2 HAVING count(*) >= 3),
n AS (SELECT pe, count(*) AS n FROM ok GROUP BY 1 HAVING count(*) >= 3),
pairs AS (SELECT a.pe, corr(a.z, b.z) AS c, stddev_pop(a.z) AS sa, stddev_pop(b.z) AS sb FROM win a JOIN win b ON a.pe = b.pe AND a.q = b.q AND a.symbol < b.symbol
  JOIN ok x ON x.pe = a.pe AND x.symbol = a.symbol JOIN ok y ON y.pe = a.pe AND y.symbol = b.symbol GROUP BY a.pe, a.symbol, b.symbol)
SELECT n.pe AS period, coalesce(sum(CASE WHEN sa > 0 AND sb > 0 THEN 2 * c END), 0) / (any_value(n) * (any_value(n) - 1)) AS comove FROM n LEFT JOIN pairs ON pairs.pe = n.pe GROUP BY 1""", ctes={"pa": CTES["pa"].replace(">= 2 THEN sum(returns)", ">= 1 THEN sum(returns)")})
def _(s, d):
    return M.comovement(panel(s, d, min_bars=1), 0.0, window=12, least=3)


CONDITIONS = f"""
SELECT period, lag(v) OVER w AS market_vol, lag(abs(m4) / nullif(v * 2, 0)) OVER w AS trend_strength, lag(ff) OVER w AS funding,
       lag(dsp) OVER w AS dispersion, lag(sign(m4)) OVER w AS direction FROM (
  SELECT period, dsp, CASE WHEN count(market) OVER b >= 8 THEN stddev_samp(market) OVER b END AS v, CASE WHEN count(f) OVER a = 4 THEN avg(f) OVER a END AS ff,
         CASE WHEN count(market) OVER a = 4 THEN sum(market) OVER a END AS m4 FROM (
    SELECT period, avg(CASE WHEN liquidity >= {FLOOR} THEN returns END) AS market, avg(CASE WHEN liquidity >= {FLOOR} THEN funding END) AS f, stddev_samp(four) AS dsp FROM (
      SELECT *, CASE WHEN count(CASE WHEN liquidity >= {FLOOR} THEN returns END) OVER r = 4 THEN sum(CASE WHEN liquidity >= {FLOOR} THEN returns END) OVER r END AS four
      FROM panel WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) GROUP BY 1)
  WINDOW a AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WINDOW w AS (ORDER BY period)"""


def conditions(s, d):
    return M.market_conditions(panel(s, d), FLOOR)


@query("m3_market_conditions", "period market_vol~6 trend_strength~6 funding~10 dispersion~6 direction~1", CONDITIONS)
def _(s, d):
    return conditions(s, d)


def past_thirds(x, source, least, by=""):
    over = f"(PARTITION BY {by} ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if by else "(ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT *, CASE WHEN lo IS NULL OR {x} IS NULL THEN NULL WHEN {x} <= lo THEN 0 WHEN {x} > hi THEN 2 ELSE 1 END::BIGINT AS third FROM (
  SELECT *, CASE WHEN count({x}) OVER w >= {least} THEN quantile_cont({x}, 1.0::DOUBLE / 3) OVER w END AS lo,
         CASE WHEN count({x}) OVER w >= {least} THEN quantile_cont({x}, 2.0::DOUBLE / 3) OVER w END AS hi FROM ({source}) WINDOW w AS {over})"""


@query("m4_past_thirds", "period third", f"SELECT period, third FROM ({past_thirds('market', 'SELECT period, market FROM wmarket', 20)})")
def _(s, d):
    return M.thirds(P.market_return(panel(s, d), FLOOR), "market", 20)


@query("m4_past_cut", "period hit", """
SELECT period, CASE WHEN cut IS NOT NULL AND market IS NOT NULL THEN (market > cut)::BIGINT END AS hit FROM (
  SELECT period, market, CASE WHEN count(market) OVER w >= 20 THEN quantile_cont(market, 0.75) OVER w END AS cut FROM wmarket
  WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(s, d):
    return M.past_cut(P.market_return(panel(s, d), FLOOR), "market", 0.75, 20, below=False)


LONG_CONDITIONS = " UNION ALL ".join(f"SELECT period, '{c}' AS condition, round({c}, 10) AS x FROM conds" for c in ("market_vol", "trend_strength", "funding", "direction"))
CELLS = {
    "conds": CONDITIONS,
    "cells": f"""SELECT period, condition, third, condition || ' ' || CASE third WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS cell FROM (
  SELECT period, condition, third FROM ({past_thirds('x', f"SELECT * FROM ({LONG_CONDITIONS}) WHERE condition <> 'direction'", 20, 'condition')})
  UNION ALL SELECT period, 'direction', CASE WHEN direction = -1 THEN 0 WHEN direction = 1 THEN 2 END::BIGINT FROM conds) WHERE third IS NOT NULL"""}


def rounded(c):
    """Conditions off the last bits, so that equal values compare equal in both engines."""
    return c.select("period", *[F.round(n, 10).alias(n) for n in c.columns if n != "period"])


def cells(s, d):
    return M.cells(rounded(conditions(s, d)), ["market_vol", "trend_strength", "funding", "direction"], least=20)


@query("m5_condition_cells", "period condition third cell", "SELECT period, condition, third, cell FROM cells", ctes=CELLS)
def _(s, d):
    return cells(s, d)


def stored_books(s, d):
    return settle(books(s, d))


@query("m7_condition_map", "condition third sharpe~6 periods share~6", """
SELECT condition, third, CASE WHEN count(*) > 2 AND max(net) > min(net) THEN avg(net) / stddev_pop(net) * sqrt(52) END AS sharpe, count(*) AS periods,
       count(*) / (SELECT count(*) FROM book) AS share FROM book JOIN cells ON cells.period = book.period GROUP BY 1, 2""", ctes=CELLS)
def _(s, d):
    p = stored_panel(s, d)
    book = K.run(trend_weights(s, d, p=p), FLAT).select("period", F.col("net").alias("r"))
    return M.condition_map(settle(book), M.cells(rounded(M.market_conditions(p, FLOOR)), ["market_vol", "trend_strength", "funding", "direction"], least=20))


@query("m7_crosstab", "a b sharpe~6 periods", """
SELECT x.third AS a, y.third AS b, CASE WHEN count(*) > 2 AND max(net) > min(net) THEN avg(net) / stddev_pop(net) * sqrt(52) END AS sharpe, count(*) AS periods
FROM book JOIN cells x ON x.period = book.period AND x.condition = 'market_vol' JOIN cells y ON y.period = book.period AND y.condition = 'funding' GROUP BY 1, 2""", ctes=CELLS)
def _(s, d):
    p = stored_panel(s, d)
    book = K.run(trend_weights(s, d, p=p), FLAT).select("period", F.col("net").alias("r"))
    c = settle(M.cells(rounded(M.market_conditions(p, FLOOR)), ["market_vol", "funding"], least=20))
    return M.crosstab(book, c.filter(F.col("condition") == "market_vol"), c.filter(F.col("condition") == "funding"))


@query("m6_walk_forward_conditions", "t fold cell r~8 live", """
WITH idx AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM book),
gb AS (SELECT c.cell, i.period, i.i, i.n, CASE WHEN k.cell IS NOT NULL THEN b.net ELSE 0 END AS r, k.cell IS NOT NULL AS live
  FROM (SELECT DISTINCT cell FROM cells) c, idx i JOIN book b ON b.period = i.period LEFT JOIN cells k ON k.cell = c.cell AND k.period = i.period),
f AS (SELECT k AS fold, floor(k * ((n - 104) / 4.0::DOUBLE) + 104.0)::BIGINT AS lo, CASE WHEN k = 3 THEN n ELSE floor((k + 1) * ((n - 104) / 4.0::DOUBLE) + 104.0)::BIGINT END AS hi
  FROM range(4) t(k), (SELECT DISTINCT n FROM idx)),
sc AS (SELECT fold, lo, hi, cell, avg(r) / nullif(stddev_pop(r), 0) AS s FROM gb, f WHERE i < lo AND live GROUP BY 1, 2, 3, 4 HAVING count(*) >= 15),
pk AS (SELECT fold, lo, hi, arg_max(cell, s) AS cell FROM sc WHERE s IS NOT NULL GROUP BY 1, 2, 3)
SELECT gb.period AS t, fold, gb.cell, r, live FROM gb JOIN pk ON pk.cell = gb.cell AND i >= lo AND i < hi""", ctes=CELLS)
def _(s, d):
    p = stored_panel(s, d)
    book = settle(K.run(trend_weights(s, d, p=p), FLAT).select(F.col("period").alias("t"), F.col("net").alias("r")))
    c = settle(M.cells(rounded(M.market_conditions(p, FLOOR)), ["market_vol", "trend_strength", "funding", "direction"], least=20)
               .select("cell", F.col("period").alias("t")))
    # A sleeve's return is the book's while its condition is on, flat otherwise.
    names = c.select("cell").distinct().agg(F.collect_set("cell")).scalar()
    every = book.withColumn("book_id", F.explode(names))
    live = c.select(F.col("cell").alias("book_id"), "t", F.lit(1.0).alias("__on"))
    gated = every.join(live, ["book_id", "t"], "left").withColumn("r", F.col("r") * F.coalesce("__on", F.lit(0.0))).drop("__on")
    return M.walk_forward_conditions(gated, c, folds=4, history=104, min_on=15).withColumnRenamed("on", "live")


@query("m8_window_sums", "book_id span total~8 periods", """
SELECT book_id, w AS span, sum(r) AS total, count(*) AS periods FROM books JOIN (VALUES ('flush', DATE '1997-05-01', DATE '1997-05-31'),
  ('spring', DATE '1998-03-01', DATE '1998-06-30'), ('late', DATE '1999-10-01', DATE '1999-12-31')) v(w, a, b) ON t >= a AND t <= b GROUP BY 1, 2""")
def _(s, d):
    return M.windows_sum(books(s, d), [("flush", "1997-05-01", "1997-05-31"), ("spring", "1998-03-01", "1998-06-30"), ("late", "1999-10-01", "1999-12-31")])


UP = "SELECT period, coalesce(lag(market) OVER (ORDER BY period) > 0, false) AS on_ FROM wmarket"


@query("m9_switches", "switches periods on_share~6", f"""
SELECT count(*) FILTER (on_ <> p) AS switches, count(*) AS periods, avg(CASE WHEN on_ THEN 1.0 ELSE 0.0 END) AS on_share
FROM (SELECT *, lag(on_) OVER (ORDER BY period) AS p FROM ({UP}))""")
def _(s, d):
    return M.switches(market_up(panel(s, d)))


@query("m9_spells", "first last periods", f"""
SELECT min(period) AS first, max(period) AS last, count(*) AS periods FROM (
  SELECT *, row_number() OVER (ORDER BY period) - row_number() OVER (PARTITION BY on_ ORDER BY period) AS k FROM ({UP})) WHERE on_ GROUP BY k""")
def _(s, d):
    return M.spells(market_up(panel(s, d)))


# Statistics -------------------------------------------------------------------------------------------------

SHARPE = "CASE WHEN count(r) > 2 AND max(r) > min(r) THEN avg(r) / stddev_pop(r) * sqrt(52) END"


@query("r2_annualised", "book_id annual_return~8 volatility~8 t_stat~6",
       "SELECT book_id, avg(r) * 52 AS annual_return, stddev_pop(r) * sqrt(52) AS volatility, avg(r) / stddev_samp(r) * sqrt(count(r)) AS t_stat FROM books GROUP BY 1")
def _(s, d):
    return R.annualised(books(s, d))


@query("r3_drawdown", "book_id drawdown~8", """
SELECT book_id, min(e - greatest(p, 0)) AS drawdown FROM (SELECT *, max(e) OVER (PARTITION BY book_id ORDER BY t) AS p FROM (
  SELECT *, sum(r) OVER (PARTITION BY book_id ORDER BY t) AS e FROM books)) GROUP BY 1""")
def _(s, d):
    return R.drawdown(books(s, d))


@query("r4_periods_per_year", "book_id periods", """
SELECT book_id, CASE median(g) WHEN 7 THEN 52 WHEN 1 THEN 365 END::BIGINT AS periods FROM (
  SELECT book_id, t - lag(t) OVER (PARTITION BY book_id ORDER BY t) AS g FROM books) GROUP BY 1""")
def _(s, d):
    return R.periods_per_year(books(s, d))


@query("r5_by_year", "book_id year value~6", f"SELECT book_id, year(t) AS year, {SHARPE} AS value FROM books GROUP BY 1, 2")
def _(s, d):
    return R.by_year(books(s, d))


@query("r5_summary", "book_id sharpe~6 annual_return~8 volatility~8 drawdown~8 periods years_positive~6", f"""
SELECT b.book_id, {SHARPE} AS sharpe, avg(r) * 52 AS annual_return, stddev_pop(r) * sqrt(52) AS volatility, any_value(dd) AS drawdown, count(r) AS periods, any_value(yp) AS years_positive
FROM books b JOIN (SELECT book_id, min(e - greatest(p, 0)) AS dd FROM (SELECT *, max(e) OVER (PARTITION BY book_id ORDER BY t) AS p FROM (
  SELECT *, sum(r) OVER (PARTITION BY book_id ORDER BY t) AS e FROM books)) GROUP BY 1) x ON x.book_id = b.book_id
JOIN (SELECT book_id, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS yp FROM (SELECT book_id, year(t) AS y, {SHARPE} AS s FROM books GROUP BY 1, 2) GROUP BY 1) y ON y.book_id = b.book_id GROUP BY 1""")
def _(s, d):
    return R.summary(stored_books(s, d))


IC_ROWS = "SELECT symbol, period, signal, lead(returns) OVER (PARTITION BY symbol ORDER BY period) AS forward FROM (SELECT *, returns AS signal FROM panel)"


@query("r6_rank_ic", "period ic~6 names", f"""
WITH b AS (SELECT * FROM ({IC_ROWS}) WHERE signal IS NOT NULL AND forward IS NOT NULL),
k AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY signal) + (count(*) OVER (PARTITION BY period, signal) - 1) / 2.0 AS a,
             rank() OVER (PARTITION BY period ORDER BY forward) + (count(*) OVER (PARTITION BY period, forward) - 1) / 2.0 AS f FROM b)
SELECT period, corr(a, f) AS ic, count(*) AS names FROM k GROUP BY 1 HAVING count(*) >= 8 AND min(a) < max(a) AND min(f) < max(f)""")
def _(s, d):
    rows = panel(s, d).withColumn("signal", F.col("returns")).withColumn("forward", F.lead("returns").over(P.own()))
    return R.rank_ic(rows, min_names=8)


@query("r7_cluster_ols", "term coef~5 se~5", """
WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity / 10 AS x, l_suppkey AS g FROM lineitem),
m AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM r),
b AS (SELECT *, n * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM m),
s AS (SELECT g, sum(y - b0 - b1 * x) AS s0, sum(x * (y - b0 - b1 * x)) AS s1 FROM r, b GROUP BY 1),
q AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*) AS c FROM s)
SELECT 'one' AS term, b0 AS coef, sqrt(k * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11)) / det AS se
FROM (SELECT *, c / (c - 1) * (n - 1) / (n - 2) AS k FROM b, q)
UNION ALL SELECT 'x', b1, sqrt(k * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11)) / det FROM (SELECT *, c / (c - 1) * (n - 1) / (n - 2) AS k FROM b, q)""")
def _(s, d):
    l = V.table(s, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.lit(1.0).alias("one"), (F.col("l_quantity") / 10).alias("x"), "l_suppkey")
    return R.cluster_ols(l, "y", ["one", "x"], "l_suppkey")


def past_next(s, d):
    return R.past_and_next(panel(s, d), (1, 2, 4), FLOOR)


PAST_NEXT = " UNION ALL ".join(f"""SELECT {n}::BIGINT AS lookback, symbol, period,
  CASE WHEN liquidity >= {FLOOR} THEN CASE WHEN count(returns) OVER r = {n} THEN sum(returns) OVER r END / nullif(vol * sqrt({n}), 0) END AS past,
  lead(CASE WHEN liquidity >= {FLOOR} THEN returns END / nullif(vol, 0)) OVER (PARTITION BY symbol ORDER BY period) AS nxt FROM panel
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in (1, 2, 4))


@query("r8_pooled_correlation", "lookback corr~6 n", f"SELECT lookback, corr(past, nxt) AS corr, count(*) AS n FROM ({PAST_NEXT}) WHERE abs(past) < 10 AND abs(nxt) < 10 GROUP BY 1")
def _(s, d):
    return R.pooled_correlation(past_next(s, d), "past", "nxt", by=("lookback",))


@query("r9_tails", "k observed~6 below~6 above~6 normal~10", """
WITH x AS (SELECT returns AS x FROM lb WHERE returns IS NOT NULL), z AS (SELECT (x - (SELECT avg(x) FROM x)) / (SELECT stddev_samp(x) FROM x) AS z FROM x)
SELECT k::BIGINT AS k, avg((abs(z) > k)::INT) AS observed, avg((z < -k)::INT) AS below, avg((z > k)::INT) AS above, any_value(n) AS normal
FROM z, (VALUES (2, 0.04550026389635842), (3, 0.0026997960632601866), (4, 6.334248366623996e-05), (5, 5.733031437583892e-07)) v(k, n) GROUP BY k""")
def _(s, d):
    from .bars_and_panel import long_bars
    return R.tails(settle(long_bars(s, d).select("returns")), "returns")


@query("r10_correlation_structure", "year names avg_corr~6 independent_bets~5 top_share~4", """
WITH RECURSIVE r AS (SELECT symbol, period, year(period) AS y, returns AS x FROM panel),
t AS (SELECT y, count(DISTINCT period) AS t FROM r GROUP BY 1),
m AS (SELECT r.y, symbol FROM r JOIN t ON t.y = r.y GROUP BY 1, 2 HAVING count(x) >= floor(0.5 * any_value(t)) AND stddev_pop(x) > 0),
z AS (SELECT r.* FROM r JOIN m ON m.y = r.y AND m.symbol = r.symbol WHERE x IS NOT NULL),
c AS MATERIALIZED (SELECT a.y, a.symbol AS i, b.symbol AS j, CASE WHEN a.symbol = b.symbol THEN 1.0 WHEN count(*) > 1 AND stddev_pop(a.x) > 1e-9 * max(abs(a.x)) AND stddev_pop(b.x) > 1e-9 * max(abs(b.x)) THEN corr(a.x, b.x) ELSE 0.0 END AS c
  FROM z a JOIN z b ON a.y = b.y AND a.period = b.period GROUP BY 1, 2, 3),
k AS (SELECT y, count(*) AS n FROM m GROUP BY 1),
v AS (SELECT y, symbol AS i, 1.0::DOUBLE AS v, 0 AS step, 0.0::DOUBLE AS size FROM m
  UNION ALL SELECT y, i, w / sqrt(sum(w * w) OVER (PARTITION BY y)), step + 1, sqrt(sum(w * w) OVER (PARTITION BY y)) FROM (
    SELECT c.y, c.i, sum(c.c * v.v) AS w, v.step FROM v JOIN c ON c.y = v.y AND c.j = v.i WHERE v.step < 600 GROUP BY c.y, c.i, v.step)),
s AS (SELECT y, any_value(size) AS top FROM v WHERE step = 600 GROUP BY 1)
SELECT k.y AS year, n AS names, (sum(c) - n) / nullif(n * (n - 1), 0)::DOUBLE AS avg_corr, n * n / sum(c * c) AS independent_bets, any_value(top) / n AS top_share
FROM k JOIN c ON c.y = k.y JOIN s ON s.y = k.y GROUP BY k.y, n""")
def _(s, d):
    return R.correlation_structure(stored_panel(s, d), share=0.5)


@query("r11_head_to_head", "book_id edge~8 edge_t~6 n when_base_loses~8 when_base_wins~8 corr~6", """
SELECT x.book_id, avg(x.r - b.r) AS edge, avg(x.r - b.r) / stddev_samp(x.r - b.r) * sqrt(count(*)) AS edge_t, count(*) AS n,
       avg(x.r) FILTER (b.r < 0) AS when_base_loses, avg(x.r) FILTER (b.r > 0) AS when_base_wins, corr(x.r, b.r) AS corr
FROM books x JOIN books b ON b.t = x.t AND b.book_id = 1 AND x.book_id <> 1 GROUP BY 1""")
def _(s, d):
    return R.head_to_head(stored_books(s, d), 1)


@query("r12_predictability", "lookback year corr~5 t~5", f"""
SELECT lookback, year(period) AS year, c AS corr, c * sqrt(n) AS t FROM (
  SELECT lookback, max(period) AS period, corr(past, nxt) AS c, count(*) AS n FROM ({PAST_NEXT}) WHERE abs(past) < 10 AND abs(nxt) < 10 GROUP BY lookback, year(period) HAVING count(*) >= 6)""")
def _(s, d):
    p = R.pooled_correlation(past_next(s, d).withColumn("year", F.year("period").cast("bigint")), "past", "nxt", by=("lookback", "year"))
    return p.filter(F.col("n") >= 6).withColumn("t", F.col("corr") * F.sqrt("n"))


LEGS = (1, 2, 4)
# Few brands of the tables have a known liquidity and full weeks together: for the legs one bar makes a week, and an unknown liquidity is 0, at the floor of 0.
LEG_CTES = {
    "pa": CTES["pa"].replace(">= 2 THEN sum(returns)", ">= 1 THEN sum(returns)"),
    "lmarket": "SELECT period, avg(CASE WHEN coalesce(liquidity, 0) >= 0 THEN returns END) AS market FROM panel GROUP BY 1",
    "mlegs": " UNION ALL ".join(f"""SELECT {n}::BIGINT AS lookback, period, CASE WHEN count(market) OVER r = {n} THEN sum(market) OVER r END / nullif(vol * sqrt({n}), 0) AS past,
      lead(market) OVER (ORDER BY period) / nullif(vol, 0) AS nxt FROM mvol WINDOW r AS (ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in LEGS),
    "mvol": """SELECT period, market, lag(v) OVER (ORDER BY period) AS vol FROM (SELECT period, market, CASE WHEN count(market) OVER w >= 8 THEN stddev_samp(market) OVER w END AS v
      FROM lmarket WINDOW w AS (ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
    "rel": "SELECT symbol, p.period, CASE WHEN coalesce(liquidity, 0) >= 0 THEN returns END - market AS rel FROM panel p JOIN lmarket m ON m.period = p.period",
    "rvol": """SELECT symbol, period, rel, lag(v) OVER (PARTITION BY symbol ORDER BY period) AS vol FROM (SELECT *, CASE WHEN count(rel) OVER w >= 8 THEN stddev_samp(rel) OVER w END AS v
      FROM rel WINDOW w AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
    "rlegs": " UNION ALL ".join(f"""SELECT {n}::BIGINT AS lookback, period, CASE WHEN count(rel) OVER r = {n} THEN sum(rel) OVER r END / nullif(vol * sqrt({n}), 0) AS signal,
      lead(rel / nullif(vol, 0)) OVER (PARTITION BY symbol ORDER BY period) AS forward FROM rvol WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in LEGS),
    "rics": """SELECT lookback, period, corr(a, f) AS ic FROM (
      SELECT lookback, period, rank() OVER (PARTITION BY lookback, period ORDER BY signal) + (count(*) OVER (PARTITION BY lookback, period, signal) - 1) / 2.0 AS a,
             rank() OVER (PARTITION BY lookback, period ORDER BY forward) + (count(*) OVER (PARTITION BY lookback, period, forward) - 1) / 2.0 AS f
      FROM rlegs WHERE signal IS NOT NULL AND forward IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 8 AND min(a) < max(a) AND min(f) < max(f)""",
}


OWN_LEG = PAST_NEXT.replace(f"liquidity >= {FLOOR}", "coalesce(liquidity, 0) >= 0")


def legs_sql(key):
    return f"""SELECT lookback, {key} leg, value, CASE WHEN leg = 'relative' THEN value / nullif(s, 0) ELSE value END * sqrt(n) AS t, n FROM (
  SELECT lookback, {key} 'own' AS leg, corr(past, nxt) AS value, NULL::DOUBLE AS s, count(*) AS n FROM (SELECT *, year(period) AS year FROM ({OWN_LEG})) WHERE abs(past) < 10 AND abs(nxt) < 10 GROUP BY ALL
  UNION ALL SELECT lookback, {key} 'market', corr(past, nxt), NULL, count(*) FROM (SELECT *, year(period) AS year FROM mlegs) WHERE past IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lookback, {key} 'relative', avg(ic), stddev_samp(ic), count(*) FROM (SELECT *, year(period) AS year FROM rics) GROUP BY ALL)
WHERE value IS NOT NULL AND NOT isnan(value)"""


@query("r12_legs", "lookback leg value~6 t~5 n", legs_sql(""), ctes=LEG_CTES)
def _(s, d):
    return R.predictability(settle(panel(s, d, min_bars=1)).fillna(0.0, ["liquidity"]), LEGS, 0.0, min_names=8)


@query("r12_legs_by_year", "lookback year leg value~6 t~4 n", legs_sql("year,"), ctes=LEG_CTES)
def _(s, d):
    return R.predictability(settle(panel(s, d, min_bars=1)).fillna(0.0, ["liquidity"]), LEGS, 0.0, min_names=8, yearly=True)


# The gate ---------------------------------------------------------------------------------------------------

from ..functions.normal import expected_max  # noqa: E402

EMAX6 = expected_max(6.0)
# The normal distribution function as its series about zero.
PHI = "0.5 + list_sum([(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * n + 1) / exp(n * ln(2) + lgamma(n + 1)) / (2 * n + 1) for n in range(0, 120)]) / sqrt(2 * pi())"
SIGNIFICANCE = f"""SELECT book_id, n, (sr - bar) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12)) AS z, bar * sqrt(52) AS luck_bar FROM (
  SELECT *, m1 / sqrt(v) AS sr, {EMAX6!r} / sqrt(n - 1) AS bar, m3 / pow(v, 1.5) AS sk, m4 / (v * v) AS ku FROM (
    SELECT b.book_id, any_value(n) AS n, any_value(m1) AS m1, avg(pow(r - m1, 2)) AS v, avg(pow(r - m1, 3)) AS m3, avg(pow(r - m1, 4)) AS m4
    FROM books b JOIN (SELECT book_id, avg(r) AS m1, count(r) AS n FROM books GROUP BY 1) a ON a.book_id = b.book_id GROUP BY 1))"""


@query("g1_significance", "book_id n z~5 probability~6 luck_bar~6", f"SELECT book_id, n, z, {PHI} AS probability, luck_bar FROM ({SIGNIFICANCE})")
def _(s, d):
    return Gt.significance(books(s, d), 6.0)


# E[max of 6] as the integral of x * 6 * density * F**5, F itself summed up from the density on a fine grid.
@query("g2_expected_max", "book_id luck~6", """
WITH g AS (SELECT (i - 160000) / 20000.0 AS x, exp(-pow((i - 160000) / 20000.0, 2) / 2) / sqrt(2 * pi()) / 20000.0 AS w FROM range(320001) r(i)),
c AS (SELECT x, w, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2 AS f FROM g),
e AS (SELECT sum(x * 6 * w * pow(f, 5)) AS top FROM c)
SELECT book_id, any_value(top) / sqrt(count(r) - 1) * sqrt(52) AS luck FROM books, e GROUP BY 1""")
def _(s, d):
    return books(s, d).groupBy("book_id").agg((F.lit(EMAX6) / F.sqrt(F.count("r") - 1) * F.sqrt(F.lit(52.0))).alias("luck"))


def mixed(source, c):
    """source with its column c permuted as gate.mixed does."""
    for add in Gt.ROUNDS:
        source = f"SELECT * REPLACE ({c} * {c} % {Gt.PRIME} * {c} % {Gt.PRIME} * {c} % {Gt.PRIME} * {c} % {Gt.PRIME} AS {c}) FROM (SELECT * REPLACE (({c} + {add}) % {Gt.PRIME} AS {c}) FROM ({source}))"
    return source


HASHED = mixed(f"SELECT pos, d, (h + d) % {Gt.PRIME} AS h FROM ({mixed('SELECT pos, pos AS h FROM (SELECT DISTINCT pos FROM zs)', 'h')}), range(20000) r(d)", "h")
UNIFORMS = mixed(mixed(f"SELECT pos, d, h AS a, (h + 1) % {Gt.PRIME} AS b FROM ({HASHED})", "a"), "b")
# The count whose E[max] is the mean of the bests, by bisection on its logarithm; E[max of n] is the integral of x * n * density * F**(n - 1).
TRIALS = f"""SELECT exp(lo) AS trials, top AS expected_best FROM (SELECT * FROM bisect ORDER BY k DESC LIMIT 1)"""
TRIAL_CTES = {
    "zs": """SELECT book_id, pos, (r - avg(r) OVER w) / stddev_pop(r) OVER w / sqrt(count(r) OVER w) AS z
      FROM (SELECT book_id, r, dense_rank() OVER (ORDER BY t) - 1 AS pos FROM books WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY book_id)""",
    "gs": f"SELECT pos, d, sqrt(-2 * ln((a + 0.5::DOUBLE) / {Gt.PRIME})) * cos(2 * pi() * (b + 0.5::DOUBLE) / {Gt.PRIME}) AS g FROM ({UNIFORMS})",
    "bests": "SELECT avg(top) AS top FROM (SELECT d, max(s) AS top FROM (SELECT book_id, d, sum(z * g) AS s FROM zs JOIN gs ON gs.pos = zs.pos GROUP BY 1, 2) GROUP BY 1)",
    "dens": "SELECT x, w, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2 AS f FROM (SELECT (i - 32000) / 4000.0::DOUBLE AS x, exp(-pow((i - 32000) / 4000.0::DOUBLE, 2) / 2) / sqrt(2 * pi()) / 4000.0 AS w FROM range(64001) r(i))",
    "bisect": """SELECT 0 AS k, 0.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, top FROM bests UNION ALL
      SELECT k + 1, CASE WHEN e < top THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e < top THEN hi ELSE (lo + hi) / 2 END, top
      FROM (SELECT k, lo, hi, top, sum(x * exp((lo + hi) / 2) * w * pow(f, exp((lo + hi) / 2) - 1)) AS e FROM bisect JOIN dens ON k < 32 GROUP BY 1, 2, 3, 4)""",
}


@query("g3_effective_trials", "trials~4 expected_best~4", TRIALS, ctes=TRIAL_CTES)
def _(s, d):
    return Gt.effective_trials(stored_books(s, d))


@query("g4_periods_needed", "book_id needed", f"""
SELECT book_id, CASE WHEN s > 0 THEN ceil(pow(({Gt.Z + Gt.normal_ppf(0.8) + EMAX6!r}) / (s / sqrt(52)), 2))::BIGINT + 1 ELSE -1 END AS needed FROM (
  SELECT book_id, {SHARPE} AS s FROM books GROUP BY 1)""")
def _(s, d):
    sh = R.sharpe(books(s, d))
    return sh.select("book_id", Gt.periods_needed(F.col("sharpe"), 6.0, 52).alias("needed"))


@query("g5_year_stability", "book_id kept~5 stable", f"""
WITH f AS (SELECT book_id, {SHARPE} AS full_ FROM books GROUP BY 1),
y AS (SELECT b.book_id, d.y, {SHARPE} AS rest FROM books b JOIN (SELECT DISTINCT book_id, year(t) AS y FROM books) d ON d.book_id = b.book_id AND year(b.t) <> d.y GROUP BY 1, 2)
SELECT f.book_id, CASE WHEN any_value(full_) > 0 THEN min(rest / full_) END AS kept, coalesce(any_value(full_) > 0 AND min(rest / full_) >= 0.4, false) AS stable
FROM f JOIN y ON y.book_id = f.book_id GROUP BY 1""")
def _(s, d):
    return Gt.year_stability(books(s, d))


@query("g6_oos_agreement", "book_id z~5 agrees", f"""
SELECT book_id, z, sb > 0 AND z <= {Gt.Z!r} AS agrees FROM (
  SELECT book_id, sb, (sa - sb) / sqrt(1.0 / (na - 1) + 1.0 / (nb - 1)) AS z FROM (
    SELECT book_id, avg(r) FILTER (p <= 3) / stddev_pop(r) FILTER (p <= 3) AS sa, count(r) FILTER (p <= 3) AS na,
           avg(r) FILTER (p > 3) / stddev_pop(r) FILTER (p > 3) AS sb, count(r) FILTER (p > 3) AS nb
    FROM (SELECT *, ntile(5) OVER (PARTITION BY book_id ORDER BY t) AS p FROM books) GROUP BY 1))""")
def _(s, d):
    b = settle(Gt.first_three_fifths(books(s, d)))
    return Gt.oos_agree(b.filter("train"), b.filter(~F.col("train")))


@query("g6_neighbours", "book_id z~5 agrees", f"""
SELECT book_id, z, s1 > 0 AND z <= {Gt.Z!r} AS agrees FROM (
  SELECT book_id, s1, (s0 - s1) / sqrt(greatest(2 - 2 * rho, 1e-12) / (n - 1)) AS z FROM (
    SELECT x.book_id, avg(b.r) / stddev_samp(b.r) AS s0, avg(x.r) / stddev_samp(x.r) AS s1, corr(b.r, x.r) AS rho, count(*) AS n
    FROM books x JOIN books b ON b.t = x.t AND b.book_id = 2 WHERE x.book_id IN (1, 3) GROUP BY 1))""")
def _(s, d):
    return Gt.neighbours_agree(stored_books(s, d), 2, [1, 3])


@query("g7_walk_forward", "t fold book_id r~8", """
WITH idx AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM books)),
f AS (SELECT k AS fold, floor(k * ((n - 104) / 6.0::DOUBLE) + 104.0)::BIGINT AS lo, CASE WHEN k = 5 THEN n ELSE floor((k + 1) * ((n - 104) / 6.0::DOUBLE) + 104.0)::BIGINT END AS hi
  FROM range(6) q(k), (SELECT DISTINCT n FROM idx)),
pk AS (SELECT fold, lo, hi, arg_max(book_id, s) AS book_id FROM (
  SELECT fold, lo, hi, book_id, avg(r) / nullif(stddev_pop(r), 0) AS s FROM books b JOIN idx ON idx.t = b.t, f WHERE i < lo GROUP BY 1, 2, 3, 4 HAVING count(r) > 2) WHERE s IS NOT NULL GROUP BY 1, 2, 3)
SELECT b.t, fold, b.book_id, r FROM books b JOIN idx ON idx.t = b.t JOIN pk ON pk.book_id = b.book_id AND i >= lo AND i < hi""")
def _(s, d):
    return Gt.walk_forward(stored_books(s, d))


@query("g7_walk_forward_pick", "t fold book_id r~8", """
WITH idx AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM books)),
f AS (SELECT k AS fold, floor(k * ((n - 104) / 6.0::DOUBLE) + 104.0)::BIGINT AS lo, CASE WHEN k = 5 THEN n ELSE floor((k + 1) * ((n - 104) / 6.0::DOUBLE) + 104.0)::BIGINT END AS hi
  FROM range(6) q(k), (SELECT DISTINCT n FROM idx)),
sc AS (SELECT fold, lo, hi, book_id, count(*) FILTER (r > 0) AS up FROM books b JOIN idx ON idx.t = b.t, f WHERE i < lo GROUP BY 1, 2, 3, 4),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY up DESC, book_id) AS k FROM sc) WHERE k = 1)
SELECT b.t, fold, b.book_id, r FROM books b JOIN idx ON idx.t = b.t JOIN pk ON pk.book_id = b.book_id AND i >= lo AND i < hi""")
def _(s, d):
    # The book with most rising periods so far.
    up = lambda past: past.groupBy("fold", "book_id").agg(F.count_if(F.col("r") > 0).alias("up")).groupBy("fold").agg(F.min_by("book_id", F.struct(-F.col("up"), F.col("book_id"))).alias("book_id"))
    return Gt.walk_forward(stored_books(s, d), pick=up)


@query("s19_trial_sink", "name periods total~4 recordings digests", """
SELECT book_id::VARCHAR AS name, count(r) AS periods, sum(r::FLOAT::DOUBLE) AS total, CASE WHEN book_id = 1 THEN 2 ELSE 1 END AS recordings, CASE WHEN book_id = 1 THEN 2 ELSE 1 END AS digests
FROM (SELECT book_id, CASE WHEN book_id = 1 THEN 2 * r ELSE r END AS r FROM books) GROUP BY book_id""")
def _(s, d):
    # All books, the same ones again, which writes nothing, and then one of them changed.
    path, rows = f"{shared_dir(s)}/tidemark/trials-{uuid.uuid4().hex}", stored_books(s, d).select("book_id", "t", "r")
    for k, b in enumerate((rows, rows, rows.withColumn("r", F.when(F.col("book_id") == 1, F.col("r") * 2).otherwise(F.col("r"))))):
        Tr.record(b, path, F.lit(f"2024-01-0{k + 1}").cast("timestamp"))
    sink = s.read.parquet(path)
    said = sink.groupBy("name").agg(F.count_distinct("recorded").alias("recordings"), F.count_distinct("digest").alias("digests"))
    last = Tr.latest(sink).groupBy("name").agg(F.count("r").alias("periods"), F.sum(F.col("r").cast("double")).alias("total"))
    return last.join(said, "name")


@query("g8_pbo", "combos pbo~6", """
WITH ok AS (SELECT t FROM books GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT book_id) FROM books)),
bl AS (SELECT t, ntile(16) OVER (ORDER BY t) - 1 AS b FROM ok),
m AS (SELECT book_id, b, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM books JOIN bl ON bl.t = books.t GROUP BY 1, 2),
co AS (SELECT c FROM range(65536) r(c) WHERE bit_count(c::INTEGER) = 8),
x AS (SELECT c, book_id, sum(s) FILTER (i) / sum(n) FILTER (i) AS ma, sum(q) FILTER (i) / sum(n) FILTER (i) AS qa, sum(s) FILTER (NOT i) / sum(n) FILTER (NOT i) AS mb, sum(q) FILTER (NOT i) / sum(n) FILTER (NOT i) AS qb
  FROM (SELECT co.c, m.*, (co.c >> m.b) & 1 = 1 AS i FROM co, m) GROUP BY 1, 2),
z AS (SELECT c, book_id, ma / sqrt(qa - ma * ma) AS a, mb / sqrt(qb - mb * mb) AS b FROM x),
w AS (SELECT c, arg_max(b, a) AS bx, count(*) AS k FROM z GROUP BY 1),
rk AS (SELECT z.c, any_value(k) AS k, count(*) FILTER (b < bx) + (count(*) FILTER (b = bx) + 1) / 2.0 AS rank FROM z JOIN w ON w.c = z.c GROUP BY 1)
SELECT count(*) AS combos, avg(CASE WHEN rank / (k + 1) <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM rk""")
def _(s, d):
    return Gt.pbo(stored_books(s, d))


@query("g9_bootstrap", "book_id sharpe_5~6 sharpe_50~6 sharpe_95~6 ends_above_zero~6 drawdown_50~6 drawdown_5~6", """
WITH v AS (SELECT book_id, r, row_number() OVER (PARTITION BY book_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM books WHERE r IS NOT NULL),
z AS (SELECT DISTINCT book_id, n, least(8, n) AS w FROM v),
st AS (SELECT book_id, n, w, d, k, ('0x' || substr(md5(book_id || '|0|' || d || '|' || k), 1, 8))::BIGINT % (n - w + 1) AS b
  FROM z, range(5000) x(d), (SELECT unnest(range((SELECT max(n) FROM z))) AS k) WHERE k * w < n),
x AS (SELECT st.book_id, d, k * w + o AS p, v.r FROM st, range(8) y(o) JOIN v ON v.book_id = st.book_id AND v.i = b + o WHERE o < w AND k * w + o < st.n),
c AS (SELECT *, sum(r) OVER (PARTITION BY book_id, d ORDER BY p ROWS UNBOUNDED PRECEDING) AS t FROM x),
f AS (SELECT *, t - max(t) OVER (PARTITION BY book_id, d ORDER BY p ROWS UNBOUNDED PRECEDING) AS fall FROM c),
q AS (SELECT book_id, d, avg(r) / nullif(stddev_pop(r), 0) * sqrt(52) AS s, arg_max(t, p) AS last, min(fall) AS fall FROM f GROUP BY 1, 2)
SELECT book_id, quantile_cont(s, 0.05) AS sharpe_5, quantile_cont(s, 0.5) AS sharpe_50, quantile_cont(s, 0.95) AS sharpe_95,
  avg(CASE WHEN last > 0 THEN 1.0 ELSE 0.0 END) AS ends_above_zero, quantile_cont(fall, 0.5) AS drawdown_50, quantile_cont(fall, 0.05) AS drawdown_5 FROM q GROUP BY 1""")
def _(s, d):
    return Gt.bootstrap(books(s, d))


@query("g10_purged_folds", "fold role rows keys", """
WITH p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate AS t FROM orders)),
f AS (SELECT k AS fold, fst + k * sz AS lo, CASE WHEN k = 4 THEN n ELSE fst + (k + 1) * sz END AS hi FROM range(5) r(k), (
  SELECT DISTINCT n, floor(n * 0.3)::BIGINT AS fst, (n - floor(n * 0.3)::BIGINT) // 5 AS sz FROM p)),
x AS (SELECT fold, o_orderkey, CASE WHEN pos >= lo AND pos < hi THEN 'test' WHEN pos < lo - 1 OR pos >= hi + 6 THEN 'train' END AS role FROM orders JOIN p ON p.t = o_orderdate, f)
SELECT fold, role, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM x WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", "o_orderdate")
    f = Gt.purged_folds(o, "o_orderdate")
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("g11_three_fifths", "book_id t train", "SELECT book_id, t, ntile(5) OVER (PARTITION BY book_id ORDER BY t) <= 3 AS train FROM books")
def _(s, d):
    return Gt.first_three_fifths(books(s, d))


@query("g12_trial_table", "key name kind first last periods",
       "SELECT book_id::VARCHAR AS key, book_id::VARCHAR AS name, 'exploratory' AS kind, min(t) AS first, max(t) AS last, count(r) AS periods FROM books GROUP BY book_id")
def _(s, d):
    from ..session import shared_dir
    import uuid
    path = f"{shared_dir(s)}/tidemark/trials-{uuid.uuid4().hex}"
    b = stored_books(s, d)
    # The same trials twice, the second time doubled for some: the changed ones are replaced, the rest written once.
    Tr.record(b, path)
    Tr.record(b.withColumn("r", F.when(F.col("book_id") <= 2, F.col("r") * 2).otherwise(F.col("r"))), path)
    return Tr.table(s.read.parquet(path))


@query("g12_trial_frame", "book_id t r~5", "SELECT book_id::VARCHAR AS book_id, t, CASE WHEN book_id <= 2 THEN r * 2 ELSE r END::FLOAT::DOUBLE AS r FROM books")
def _(s, d):
    from ..session import shared_dir
    import uuid
    path = f"{shared_dir(s)}/tidemark/trials-{uuid.uuid4().hex}"
    b = stored_books(s, d)
    Tr.record(b, path)
    Tr.record(b.withColumn("r", F.when(F.col("book_id") <= 2, F.col("r") * 2).otherwise(F.col("r"))), path)
    return Tr.frame(s.read.parquet(path))


@query("g13_score", "book_id sharpe~6 probability~6 failed stamp")
def _(s, d):
    b = stored_books(s, d)
    halves = settle(Gt.first_three_fifths(b))
    oos = Gt.oos_agree(halves.filter("train"), halves.filter(~F.col("train")))
    return Gt.score(b, 6.0, oos=oos).withColumn("failed", F.concat_ws(" ", "failed"))


VARIANTS = {
    "vsig": "SELECT *, 'base' AS variant, 1.0 AS mult FROM wt UNION ALL SELECT *, 'twice' AS variant, 2.0 FROM wt UNION ALL "
            "SELECT * REPLACE (lag(weight) OVER (PARTITION BY symbol ORDER BY period) AS weight), 'late', 1.0 FROM wt UNION ALL "
            f"SELECT wt.* REPLACE (b.weight AS weight), 'basket', 1.0 FROM wt JOIN ({BASKET}) b ON b.symbol = wt.symbol AND b.period = wt.period",
    "vhw": CTES["hw"].replace("PARTITION BY symbol", "PARTITION BY variant, symbol").replace("FROM wt", "FROM vsig"),
    "vlegs": CTES["legs"].replace("PARTITION BY symbol", "PARTITION BY variant, symbol").replace("FROM hw", "FROM vhw"),
    "vbook": CTES["book"].replace("SELECT period, gross, funding", "SELECT variant, period, gross, funding").replace("OVER () AS start", "OVER (PARTITION BY variant) AS start")
    .replace("SELECT period, sum(weight", "SELECT variant, period, sum(weight").replace("FROM legs GROUP BY 1", "FROM vlegs GROUP BY 1, 2").replace("-dw *", "-dw * mult *"),
}


@query("g14_variant_checks", "variant sharpe~6 periods", "SELECT variant, avg(net) / stddev_pop(net) * sqrt(52) AS sharpe, count(*) AS periods FROM vbook GROUP BY 1", ctes=VARIANTS)
def _(s, d):
    w = S.basket(trend_weights(s, d), FLOOR, name="basket").withColumn("late", P.lagged("weight"))
    # Twice the cost, a week late and the plain basket are rows of one job.
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(m).alias("mult"), F.col(c).alias("weight"))
                  for n, m, c in (("base", 1.0, "weight"), ("twice", 2.0, "weight"), ("late", 1.0, "late"), ("basket", 1.0, "basket"))])
    w = w.withColumn("__v", F.explode(v)).drop("weight", "late", "basket").select("*", "__v.*").drop("__v")
    r = K.run(w, FLAT, by=("variant",), cost_mult="mult")
    return r.groupBy("variant").agg(M_.sharpe("net", 52).alias("sharpe"), F.count("net").alias("periods"))
