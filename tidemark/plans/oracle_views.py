"""Common table expressions of the DuckDB oracles, written from the operators' definitions, not from their plans."""
from __future__ import annotations

# Parameters shared by the queries and their oracles.
WARMUP, MIN_BARS, FLOOR, FLAT_BPS = 0, 2, 20000.0, 10.0
REDENOMINATION = ("Brand#12", "1998-06-01")

CTES: dict[str, str] = {
    "bd": """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS at, MAX(l_extendedprice / l_quantity) AS high,
       MIN(l_extendedprice / l_quantity) AS low, SUM(l_extendedprice) / SUM(l_quantity) AS close,
       SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "prints": """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) + 2 AS t, AVG(l_discount - 0.05) / 100 AS funding_rate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "trades": """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS qty,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side
FROM events WHERE event_type <> 'error'""",
    "ord": """
SELECT o_orderkey AS order_id, 'Brand#' || (o_orderkey % 5 + 1) || ((o_orderkey // 5) % 5 + 1) AS symbol,
       c_mktsegment AS account, CAST(o_orderdate AS DATE) AS t,
       CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice / 10000 AS qty
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fills": """
SELECT c_mktsegment AS account, n_name AS instrument, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq,
       CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS qty,
       o_totalprice / 1000 AS price, CAST(o_orderkey % 5 + 1 AS DOUBLE) * (o_totalprice / 1000) * 0.0004 AS fee
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "marks": """
SELECT instrument, t + (7 - isodow(t))::INTEGER AS t, AVG(price) AS price FROM fills GROUP BY 1, 2""",
    "nfunding": """
SELECT instrument, last_day(t) + 1 AS t, (AVG(qty) - 3) / 1000 AS rate FROM fills GROUP BY 1, 2""",
    "cost_rows": """
SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) + INTERVAL 12 MONTH AS DATE) AS week_start, AVG(l_tax) * 100 AS half_spread_bps,
       AVG(l_discount) AS impact_bps_per_unit, 5.0::DOUBLE AS taker_fee_bps
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    # Long bars.
    "cal": "SELECT at, row_number() OVER (ORDER BY at) AS bar FROM (SELECT DISTINCT at FROM bd)",
    "lb0": """
SELECT b.symbol, b.at, c.bar, b.high, b.low, b.close, b.volume, b.volume > 0 AS traded,
       CASE WHEN b.volume > 0 THEN b.volume * b.close END AS dollar_volume, CASE WHEN b.volume > 0 THEN ln(b.close) END AS lvl
FROM bd b JOIN cal c ON b.at = c.at""",
    "lb": f"""
SELECT symbol, at, bar, high, low, close, volume, traded, dollar_volume,
       CASE WHEN traded AND lag(traded) OVER w AND bar - lag(bar) OVER w = 1
                 AND sum(CASE WHEN traded THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY at ROWS UNBOUNDED PRECEDING) > {WARMUP}
            THEN lvl - lag(lvl) OVER w END AS returns,
       CASE WHEN traded AND NOT (symbol = '{REDENOMINATION[0]}' AND at = DATE '{REDENOMINATION[1]}')
            THEN lvl - last_value(lvl IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       END AS held
FROM lb0 WINDOW w AS (PARTITION BY symbol ORDER BY at)""",
    "paid": """
SELECT p.symbol, b.at, SUM(p.funding_rate) AS funding
FROM prints p ASOF JOIN bd b ON p.symbol = b.symbol AND p.t <= b.at
JOIN (SELECT symbol, MIN(at) AS first FROM bd GROUP BY 1) f ON p.symbol = f.symbol
WHERE p.t >= f.first GROUP BY 1, 2""",
    "lbf": "SELECT lb.*, coalesce(paid.funding, 0) AS funding FROM lb LEFT JOIN paid ON lb.symbol = paid.symbol AND lb.at = paid.at",
    # Trailing features over 60 and 30 days.
    "rolled": """
SELECT *, lag(v0) OVER w AS vol, lag(l0) OVER w AS liquidity FROM (
  SELECT *, CASE WHEN count(returns) OVER r60 >= 10 THEN stddev_samp(returns) OVER r60 END AS v0,
         CASE WHEN count(dollar_volume) OVER r30 >= 5 THEN quantile_cont(dollar_volume, 0.5) OVER r30 END AS l0
  FROM lbf
  WINDOW r60 AS (PARTITION BY symbol ORDER BY at RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW),
         r30 AS (PARTITION BY symbol ORDER BY at RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
WINDOW w AS (PARTITION BY symbol ORDER BY at)""",
    "mkt": f"SELECT at, AVG(returns) AS market FROM rolled WHERE liquidity >= {FLOOR} AND returns IS NOT NULL GROUP BY 1",
    # Dense bar grid and weekly panel.
    "g0": """
SELECT s.symbol, c.at, c.bar, coalesce(b.traded, false) AS traded, b.dollar_volume, b.returns, b.held, b.funding, b.close
FROM (SELECT symbol, MIN(bar) AS fb FROM lb GROUP BY 1) s JOIN cal c ON c.bar >= s.fb
LEFT JOIN lbf b ON b.symbol = s.symbol AND b.bar = c.bar""",
    "g": """
SELECT *, CASE WHEN count(dollar_volume) OVER r >= 20 THEN quantile_cont(dollar_volume, 0.5) OVER r END AS liq,
       traded AND NOT coalesce(lag(traded) OVER w, false) AS reopen,
       max(CASE WHEN traded THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) = 1 AS later
FROM g0 WINDOW w AS (PARTITION BY symbol ORDER BY bar), r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "pa": f"""
SELECT symbol, at + (7 - isodow(at))::INTEGER AS period, CASE WHEN count(returns) >= {MIN_BARS} THEN sum(returns) END AS returns,
       exp(sum(held)) - 1 AS pnl, arg_max(liq, bar) FILTER (liq IS NOT NULL) AS liq, sum(coalesce(funding, 0)) AS funding,
       sum(held) FILTER (reopen) AS gap, arg_max(NOT traded, bar) AS idle, arg_max(later, bar) AS later, max(at) AS last_at
FROM g GROUP BY 1, 2""",
    "spine": """
SELECT symbol, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS period
FROM (SELECT symbol, min(period) AS a, max(period) AS b FROM pa GROUP BY 1)""",
    "panel": """
SELECT s.symbol, s.period, p.returns, p.pnl, lag(p.liq) OVER w AS liquidity, lag(v) OVER w AS vol, coalesce(p.funding, 0) AS funding,
       coalesce(lag(coalesce(idle AND later, false)) OVER w, false) AS halted, gap, last_at
FROM spine s LEFT JOIN (
  SELECT s.symbol AS sy, s.period AS pe,
         CASE WHEN count(returns) OVER r >= 8 THEN stddev_samp(returns) OVER r END AS v, pa.* EXCLUDE (symbol, period)
  FROM spine s LEFT JOIN pa ON s.symbol = pa.symbol AND s.period = pa.period
  WINDOW r AS (PARTITION BY s.symbol ORDER BY s.period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) p ON s.symbol = p.sy AND s.period = p.pe
WINDOW w AS (PARTITION BY s.symbol ORDER BY s.period)""",
    "wmarket": f"SELECT period, AVG(CASE WHEN liquidity >= {FLOOR} THEN returns END) AS market FROM panel GROUP BY 1",
    # Trend signal, weights and the flat-cost book.
    "sig": """
SELECT *, lag(s0) OVER (PARTITION BY symbol ORDER BY period) AS signal FROM (
  SELECT *, CASE WHEN count(returns) OVER r = 2 THEN sign(sum(returns) OVER r) END AS s0 FROM panel
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))""",
    "wt": f"""
SELECT * EXCLUDE (raw), raw / nullif(sum(abs(raw)) OVER (PARTITION BY period), 0) AS weight FROM (
  SELECT *, CASE WHEN liquidity >= {FLOOR} AND vol > 0 THEN signal / vol END AS raw FROM sig)""",
    "hw": """
SELECT * EXCLUDE (weight, w0), last_value(CASE WHEN NOT halted OR rn = 1 THEN w0 END IGNORE NULLS)
         OVER (PARTITION BY symbol ORDER BY period ROWS UNBOUNDED PRECEDING) AS weight
FROM (SELECT *, coalesce(weight, 0) AS w0, row_number() OVER (PARTITION BY symbol ORDER BY period) AS rn FROM wt)""",
    "legs": "SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY period), 0)) AS dw FROM hw",
    "book": f"""
SELECT period, gross, funding, cost, turnover, gross + funding + cost AS net FROM (
  SELECT *, min(period) FILTER (held > 0) OVER () AS start FROM (
    SELECT period, sum(weight * coalesce(pnl, 0)) AS gross, sum(-weight * funding) AS funding, sum(-dw * {FLAT_BPS} / 1e4) AS cost,
           sum(dw) AS turnover, sum(abs(weight)) AS held FROM legs GROUP BY 1))
WHERE start IS NULL OR period >= start""",
}

LOOKBACKS = (1, 2, 3, 4, 5, 6)
CTES.update({
    # The lookback sweep as books keyed by lookback.
    "lsig": """
SELECT * EXCLUDE (s0), lag(s0) OVER (PARTITION BY lookback, symbol ORDER BY period) AS signal FROM (""" + " UNION ALL ".join(f"""
  SELECT *, {n}::BIGINT AS lookback, CASE WHEN count(returns) OVER r = {n} THEN sign(sum(returns) OVER r) END AS s0 FROM panel
  WINDOW r AS (PARTITION BY symbol ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in LOOKBACKS) + ")",
    "lwt": CTES["wt"].replace("PARTITION BY period", "PARTITION BY lookback, period").replace("FROM sig", "FROM lsig"),
    "lhw": CTES["hw"].replace("PARTITION BY symbol", "PARTITION BY lookback, symbol").replace("FROM wt", "FROM lwt"),
    "llegs": CTES["legs"].replace("PARTITION BY symbol", "PARTITION BY lookback, symbol").replace("FROM hw", "FROM lhw"),
    "lbook": CTES["book"].replace("SELECT period, gross, funding", "SELECT lookback, period, gross, funding")
    .replace("OVER () AS start", "OVER (PARTITION BY lookback) AS start").replace("SELECT period, sum(weight", "SELECT lookback, period, sum(weight")
    .replace("FROM legs GROUP BY 1", "FROM llegs GROUP BY 1, 2"),
    "books": "SELECT lookback AS book_id, period AS t, net AS r FROM lbook",
})


def sliced_ctes() -> dict[str, str]:
    """The panel-to-book chain once per rebalance weekday, names suffixed by the weekday."""
    import re
    chain, out = ("pa", "spine", "panel", "sig", "wt", "hw", "legs", "book"), {}
    for k in range(7):
        for name in chain:
            text = CTES[name].replace("(7 - isodow(at))::INTEGER", f"((({k} + 1) - isodow(at) + 7) % 7)::INTEGER")
            for ref in chain:
                text = re.sub(rf"(FROM|JOIN) {ref}\b", rf"\1 {ref}_{k}", text)
            text = text.replace("pa.", f"pa_{k}.") if name == "panel" else text
            out[f"{name}_{k}"] = text
        day = f"(g.at + ((({k} + 1) - isodow(g.at) + 7) % 7)::INTEGER)"
        out[f"drift_{k}"] = f"""
SELECT at, sum(weight * (exp(s) - exp(s - h))) AS gross FROM (
  SELECT g.at, {day} AS period, w.weight, coalesce(held, 0) AS h,
         sum(coalesce(held, 0)) OVER (PARTITION BY g.symbol, {day} ORDER BY g.at) AS s
  FROM g JOIN hw_{k} w ON w.symbol = g.symbol AND w.period = {day}) GROUP BY 1"""
        out[f"bybar_{k}"] = f"""
SELECT d.at, d.gross, coalesce(f.funding, 0) AS funding, coalesce(f.cost, 0) AS cost, coalesce(f.turnover, 0) AS turnover FROM drift_{k} d LEFT JOIN (
  SELECT l.at, b.funding, b.cost, b.turnover FROM book_{k} b JOIN (
    SELECT {day} AS period, max(at) AS at FROM g GROUP BY 1) l ON l.period = b.period) f ON f.at = d.at"""
    return out
