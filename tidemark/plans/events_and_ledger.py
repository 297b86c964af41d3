"""Queries for event books and portfolio accounting (E, L)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DAY
from ..operators import asof, costs as C, events as E, ledger as L
from ..session import settle
from . import views as V
from .bars_and_panel import rolled
from .oracle_views import CTES, FLAT_BPS
from .registry import query

EXITS = E.Barriers(target=1.0, stop=1.0, horizon=5, wait=1)
REVERT = E.Barriers(target=None, stop=2.0, horizon=6, fade=0.5)
SLOTS = 10


def event_bars(s, d):
    return settle(rolled(s, d).select("symbol", "at", "traded", "held", "returns", "funding", "vol", "liquidity"))


def triggers(b):
    """Returns beyond one vol, faded: the side is against the move."""
    return (b.filter(F.abs("returns") > F.col("vol"))
            .select(F.concat_ws("@", "symbol", F.col("at").cast("string")).alias("trade"), "symbol", "at",
                    (-F.signum("returns")).alias("side"), (F.abs("returns") / F.col("vol")).alias("strength"),
                    (F.abs("returns") / F.col("vol")).alias("gap")))


EV = {
    "lv": """SELECT symbol, at, traded, held, funding, vol, liquidity, row_number() OVER (PARTITION BY symbol ORDER BY at) - 1 AS i,
  sum(coalesce(held, 0)) OVER (PARTITION BY symbol ORDER BY at ROWS UNBOUNDED PRECEDING) AS level, count(*) OVER (PARTITION BY symbol) - 1 AS last
FROM rolled""",
    "tr": "SELECT symbol || '@' || at::VARCHAR AS trade, symbol, at, -sign(returns) AS side, abs(returns) / vol AS strength FROM rolled WHERE abs(returns) > vol",
    "en": """SELECT t.trade, t.symbol, side, strength, b.vol, b.level AS trigger_level, f.i AS e, f.at AS entry, f.last, f.level AS entry_level
FROM tr t JOIN lv b ON b.symbol = t.symbol AND b.at = t.at JOIN lv f ON f.symbol = t.symbol AND f.i = b.i + 1 WHERE f.traded AND b.vol > 0""",
    "hits": """SELECT trade, min(i) AS x_hit, arg_min(why, i) AS why FROM (
  SELECT en.trade, b.i, CASE WHEN en.side * (b.level - entry_level) / en.vol <= -1.0 THEN 'stop' WHEN en.side * (b.level - entry_level) / en.vol >= 1.0 THEN 'take' END AS why
  FROM en JOIN lv b ON b.symbol = en.symbol AND b.i > e AND b.i <= e + 5 AND b.traded) WHERE why IS NOT NULL GROUP BY 1""",
    "cand": """SELECT c.*, coalesce(x_hit, x_time) AS x, CASE WHEN x_hit IS NOT NULL THEN why WHEN x_time = e + 5 THEN 'time' WHEN x_time > e + 5 THEN 'halt' ELSE 'end' END AS reason FROM (
  SELECT en.*, x_hit, why, coalesce((SELECT min(b.i) FROM lv b WHERE b.symbol = en.symbol AND b.traded AND b.i >= least(en.e + 5, en.last)), en.last) AS x_time
  FROM en LEFT JOIN hits ON hits.trade = en.trade) c""",
    "held_": """SELECT c.trade, c.symbol, b.at, b.i, 0.1 * side * (exp(b.level - c.entry_level) - exp(p.level - c.entry_level)) AS gross,
  -0.1 * side * exp(p.level - c.entry_level) * b.funding AS funding
FROM cand c JOIN lv b ON b.symbol = c.symbol AND b.i > c.e AND b.i <= c.x JOIN lv p ON p.symbol = c.symbol AND p.i = b.i - 1""",
    "fees": """SELECT trade, entry AS at, -0.1 * 10.0 / 1e4 AS cost FROM cand
UNION ALL SELECT trade, b.at, -0.1 * exp(b.level - c.entry_level) * 10.0 / 1e4 FROM cand c JOIN lv b ON b.symbol = c.symbol AND b.i = c.x""",
}


def setup(s, d):
    b = event_bars(s, d)
    return settle(E.path(b)), triggers(b)


@query("e1_levels", "symbol at i level~8 last", "SELECT symbol, at, i, level, last FROM lv", ctes=EV)
def _(s, d):
    return E.path(event_bars(s, d)).withColumns({"i": F.col("n"), "level": F.col("cum"), "last": F.col("end.n")})


@query("e2_hedged_levels", "symbol at traded spread~8 h_funding~10", """
SELECT b.symbol, b.at, b.traded AND coalesce(h.traded, false) AS traded,
  b.level - last_value(h.level IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.at ROWS UNBOUNDED PRECEDING) AS spread, coalesce(h.funding, 0) AS h_funding
FROM lv b LEFT JOIN (SELECT * FROM lv WHERE symbol = 'Brand#11') h ON h.at = b.at WHERE b.symbol <> 'Brand#11'""", ctes=EV)
def _(s, d):
    return E.hedge(E.path(event_bars(s, d)), "Brand#11").withColumn("spread", F.col("watched"))


@query("e3_entries", "trade symbol side~1 strength~5 e entry entry_level~8", "SELECT trade, symbol, side, strength, e, entry, entry_level FROM en", ctes=EV)
def _(s, d):
    lv, tr = setup(s, d)
    return E.opened(lv, tr, EXITS).withColumn("entry_level", F.col("base"))


@query("e4_barrier_hits", "trade x_hit why", "SELECT trade, x_hit, why FROM hits", ctes=EV)
def _(s, d):
    lv, tr = setup(s, d)
    t = E.touches(E.opened(lv, tr, EXITS), EXITS).where("touch is not null")
    return t.select("trade", F.col("touch.n").alias("x_hit"), F.col("touch.why").alias("why"))


CANDIDATES = "SELECT trade, symbol, side, c.e, entry, x, (SELECT at FROM lv WHERE lv.symbol = c.symbol AND lv.i = c.x) AS exit, reason FROM cand c"


@query("e5_candidates", "trade symbol side~1 e entry x exit reason", CANDIDATES, ctes=EV)
def _(s, d):
    lv, tr = setup(s, d)
    return E.outcomes(lv, tr, EXITS)


REV = {**EV, "en": EV["en"].replace("b.i + 1", "b.i"),
       "hits": """SELECT trade, min(i) AS x_hit, arg_min(why, i) AS why FROM (
  SELECT en.trade, b.i, CASE WHEN en.side * (b.level - entry_level) / en.vol <= -2.0 THEN 'stop' WHEN en.side * (b.level - trigger_level) / en.vol >= 0.5 * strength THEN 'revert' END AS why
  FROM en JOIN lv b ON b.symbol = en.symbol AND b.i > e AND b.i <= e + 6 AND b.traded) WHERE why IS NOT NULL GROUP BY 1""",
       "cand": EV["cand"].replace("e + 5", "e + 6")}


@query("e5_revert_candidates", "trade symbol side~1 e entry x exit reason", CANDIDATES, ctes=REV)
def _(s, d):
    lv, tr = setup(s, d)
    return E.outcomes(lv, tr, REVERT)


def stored_candidates(s, d):
    lv, tr = setup(s, d)
    return lv, settle(E.outcomes(lv, tr, EXITS))


# The greedy rule with the open trades as a list that a recursion carries along.
@query("e6_overlap_walk", "trade symbol entry exit reason", f"""
WITH RECURSIVE o AS (
  SELECT c.trade, c.symbol, c.entry, l.at AS exit, c.reason, row_number() OVER (ORDER BY c.entry, -abs(c.strength), c.trade) AS n FROM cand c JOIN lv l ON l.symbol = c.symbol AND l.i = c.x),
w AS (
  SELECT 0::BIGINT AS n, []::STRUCT(s VARCHAR, x TIMESTAMP)[] AS held, false AS taken
  UNION ALL
  SELECT n, CASE WHEN ok THEN list_append(live, {{'s': symbol, 'x': exit::TIMESTAMP}}) ELSE live END, ok FROM (
    SELECT *, len(live) < {SLOTS} AND len(list_filter(live, lambda h: h.s = symbol)) < 1 AS ok FROM (
      SELECT o.n, o.symbol, o.exit, list_filter(w.held, lambda h: h.x > o.entry) AS live FROM w JOIN o ON o.n = w.n + 1)))
SELECT o.trade, o.symbol, o.entry, o.exit, o.reason FROM o JOIN w ON w.n = o.n WHERE w.taken""", ctes=EV)
def _(s, d):
    _lv, c = stored_candidates(s, d)
    return E.admitted(c, SLOTS, 1)


@query("e7_daily_book", "day gross~8 funding~8 cost~8 net~8", """
SELECT day, coalesce(g, 0) AS gross, coalesce(f, 0) AS funding, coalesce(c, 0) AS cost, coalesce(g, 0) + coalesce(f, 0) + coalesce(c, 0) AS net FROM (
  SELECT CAST(unnest(generate_series(min(at)::TIMESTAMP, max(at)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT at FROM held_ UNION ALL SELECT at FROM fees)) k
LEFT JOIN (SELECT at, sum(gross) AS g, sum(funding) AS f FROM held_ GROUP BY 1) h ON h.at = day LEFT JOIN (SELECT at, sum(cost) AS c FROM fees GROUP BY 1) x ON x.at = day""", ctes=EV)
def _(s, d):
    lv, c = stored_candidates(s, d)
    return E.by_day(E.marks(lv, c, SLOTS), E.charges(lv, c, C.flat(FLAT_BPS), SLOTS, 1.0))


@query("e8_trade_costs", "trade at cost~10", "SELECT trade, at, cost FROM fees", ctes=EV)
def _(s, d):
    lv, c = stored_candidates(s, d)
    return E.charges(lv, c, C.flat(FLAT_BPS), SLOTS, 1.0)


@query("e9_uniqueness", "trade u~8", """
SELECT trade, avg(1.0::DOUBLE / n) AS u FROM held_ h JOIN (SELECT at, count(*) AS n FROM held_ GROUP BY 1) o ON o.at = h.at GROUP BY 1""", ctes=EV)
def _(s, d):
    lv, c = stored_candidates(s, d)
    return E.crowding(settle(E.marks(lv, c, SLOTS)))


@query("e10_trade_report", "trade reason bars gross~8 funding~10 cost~10 net~8", """
SELECT c.trade, reason, x - e AS bars, coalesce(g, 0) AS gross, coalesce(f, 0) AS funding, k AS cost, coalesce(g, 0) + coalesce(f, 0) + k AS net FROM cand c
LEFT JOIN (SELECT trade, sum(gross) AS g, sum(funding) AS f FROM held_ GROUP BY 1) h ON h.trade = c.trade JOIN (SELECT trade, sum(cost) AS k FROM fees GROUP BY 1) z ON z.trade = c.trade""", ctes=EV)
def _(s, d):
    lv, c = stored_candidates(s, d)
    return E.report(c, E.marks(lv, c, SLOTS), E.charges(lv, c, C.flat(FLAT_BPS), SLOTS, 1.0))


# Ledger -----------------------------------------------------------------------------------------------------

SIGN = "CASE WHEN side = 'buy' THEN 1 ELSE -1 END"


@query("l1_positions", "account instrument seq position~4", f"""
SELECT account, instrument, seq, sum({SIGN} * qty) OVER (PARTITION BY account, instrument ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS position FROM fills""")
def _(s, d):
    return L.positions(V.fills(s, d))


@query("l2_cash_and_fees", "account instrument seq fees~6 cash~3", f"""
SELECT account, instrument, seq, sum(fee) OVER (PARTITION BY account, instrument ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS fees,
  sum(-({SIGN} * qty * price + fee)) OVER (PARTITION BY account ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cash FROM fills""")
def _(s, d):
    return L.cash_and_fees(V.fills(s, d))


LEDGER = {
    "posd": f"""SELECT account, instrument, t, sum(dq) OVER (PARTITION BY account, instrument ORDER BY t) AS position FROM (
  SELECT account, instrument, t, sum({SIGN} * qty) AS dq FROM fills GROUP BY 1, 2, 3)""",
    "flows": """SELECT f.account, n.instrument, n.t, n.rate, p.position, n.mark, coalesce(p.position * n.mark * n.rate, 0) AS flow
FROM (SELECT n.*, m.price AS mark FROM nfunding n ASOF LEFT JOIN marks m ON m.instrument = n.instrument AND m.t < n.t) n
JOIN (SELECT account, instrument, min(t) AS first FROM fills GROUP BY 1, 2) f ON f.instrument = n.instrument AND n.t >= f.first
ASOF LEFT JOIN posd p ON p.account = f.account AND p.instrument = n.instrument AND p.t <= n.t WHERE p.position <> 0""",
}


@query("l3_funding_flows", "account instrument t position~4 mark~6 flow~5 paid~5 received~5",
       "SELECT account, instrument, t, position, mark, flow, greatest(flow, 0) AS paid, greatest(-flow, 0) AS received FROM flows", ctes=LEDGER)
def _(s, d):
    return L.funding_flows(V.fills(s, d), V.marks(s, d), V.nation_funding(s, d))


def mark_events(s, d):
    """Orders as trade events and weekly marks as mark bars, per nation."""
    f = V.fills(s, d).select("instrument", "t", "seq", "price", F.lit("trade").alias("kind"))
    m = V.marks(s, d).select("instrument", "t", F.lit(0).cast("bigint").alias("seq"), "price", "kind")
    return f.unionByName(m)


@query("l4_marks", "instrument t seq kind mark~6 funding_mark~6", """
SELECT instrument, t, seq, kind, last_value(price) OVER w AS mark, last_value(CASE WHEN kind = 'mark_kline' THEN price END IGNORE NULLS) OVER w AS funding_mark FROM (
  SELECT instrument, t, seq, price, 'trade' AS kind, 0 AS b FROM fills UNION ALL SELECT instrument, t, 0, price, 'mark_kline', 1 FROM marks)
WINDOW w AS (PARTITION BY instrument ORDER BY t, b, seq ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    return L.current_marks(mark_events(s, d), block=32 * DAY)


@query("l4_mark_history", "instrument t seq mark~6 funding_mark~6", """
SELECT instrument, t, seq, price AS mark, NULL::DOUBLE AS funding_mark FROM fills UNION ALL SELECT instrument, t, 0, price, price FROM marks""")
def _(s, d):
    return L.marks_from_events(mark_events(s, d))


EQUITY = {**LEDGER,
          "ev": f"""SELECT account, instrument, t, sum({SIGN} * qty) AS dq, sum(-({SIGN} * qty * price + fee)) AS dc, NULL::DOUBLE AS mark FROM fills GROUP BY 1, 2, 3
UNION ALL SELECT f.account, m.instrument, m.t, 0, 0, m.price FROM marks m JOIN (SELECT DISTINCT account, instrument FROM fills) f ON f.instrument = m.instrument
UNION ALL SELECT f.account, n.instrument, n.t, 0, 0, NULL FROM nfunding n JOIN (SELECT DISTINCT account, instrument FROM fills) f ON f.instrument = n.instrument
UNION ALL SELECT account, instrument, t, 0, -flow, NULL FROM flows""",
          "st": """SELECT *, coalesce(pos * mk, 0) AS value FROM (SELECT account, instrument, t, dc, sum(dq) OVER w AS pos, last_value(mark IGNORE NULLS) OVER w AS mk FROM (
  SELECT account, instrument, t, sum(dq) AS dq, sum(dc) AS dc, max(mark) AS mark FROM ev GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY account, instrument ORDER BY t ROWS UNBOUNDED PRECEDING))""",
          "eq": """SELECT account, t, cash, value FROM (SELECT account, t, sum(c) OVER (PARTITION BY account ORDER BY t) AS cash, sum(v) OVER (PARTITION BY account ORDER BY t) AS value FROM (
  SELECT account, t, sum(dc) AS c, sum(dv) AS v FROM (SELECT account, t, dc, value - coalesce(lag(value) OVER (PARTITION BY account, instrument ORDER BY t), 0) AS dv FROM st) GROUP BY 1, 2))
JOIN (SELECT DISTINCT account, t FROM fills UNION SELECT account, t FROM st WHERE pos <> 0) USING (account, t)"""}


def equity(s, d):
    return L.equity(V.fills(s, d), V.marks(s, d), V.nation_funding(s, d))


@query("l5_equity", "account t cash~2 value~2 equity~2", "SELECT account, t, cash, value, cash + value AS equity FROM eq", ctes=EQUITY)
def _(s, d):
    return equity(s, d)


@query("l6_instrument_report", "account instrument position~4 mark~6 basis~4 fees~5 funding_paid~4 funding_received~4", f"""
SELECT p.account, p.instrument, position, mark, coalesce(position * mark, 0) AS basis, fees, coalesce(paid, 0) AS funding_paid, coalesce(received, 0) AS funding_received FROM (
  SELECT account, instrument, sum({SIGN} * qty) AS position, sum(fee) AS fees FROM fills GROUP BY 1, 2) p
LEFT JOIN (SELECT instrument, arg_max(price, t) AS mark FROM marks GROUP BY 1) m ON m.instrument = p.instrument
LEFT JOIN (SELECT account, instrument, sum(greatest(flow, 0)) AS paid, sum(greatest(-flow, 0)) AS received FROM flows GROUP BY 1, 2) f ON f.account = p.account AND f.instrument = p.instrument""", ctes=LEDGER)
def _(s, d):
    return L.instrument_report(V.fills(s, d), V.marks(s, d), V.nation_funding(s, d))


@query("l7_price_with_costs", "order_id reason ref~6 bps~6 fill~5 fee~6", """
SELECT order_id, reason, ref, bps, fill, fill * qty * taker_fee_bps / 1e4 AS fee FROM (
  SELECT *, CASE WHEN reason IS NULL THEN half_spread_bps + impact_bps_per_unit * qty END AS bps,
    CASE WHEN reason IS NULL THEN ref * (1 + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (half_spread_bps + impact_bps_per_unit * qty) / 1e4) END AS fill FROM (
    SELECT *, CASE WHEN ref IS NULL THEN 'NoPriceAvailable' WHEN half_spread_bps IS NULL THEN 'NoCostAvailable' END AS reason FROM (
      SELECT o.*, c.half_spread_bps, c.impact_bps_per_unit, c.taker_fee_bps FROM (
        SELECT o.*, b.close AS ref FROM ord o ASOF LEFT JOIN bd b ON b.symbol = o.symbol AND b.at <= o.t) o
      ASOF LEFT JOIN cost_rows c ON c.symbol = o.symbol AND c.week_start <= o.t)))""")
def _(s, d):
    prices = V.bars(s, d).select("symbol", F.col("at").alias("t"), F.col("close").alias("price"))
    return L.price_with_costs(V.orders(s, d), prices, V.cost_rows(s, d))


@query("l8_price_at_last", "order_id reason fill~6 fee~6", """
SELECT order_id, CASE WHEN b.close IS NULL THEN 'NoPriceAvailable' END AS reason, b.close AS fill, b.close * qty * 0.0004 AS fee
FROM ord o ASOF LEFT JOIN bd b ON b.symbol = o.symbol AND b.at <= o.t""")
def _(s, d):
    prices = V.bars(s, d).select("symbol", F.col("at").alias("t"), F.col("close").alias("price"))
    return L.price_at_last(V.orders(s, d), prices)


@query("l9_sized_orders", "account instrument seq clamped~4 delta~4 side qty~4 outcome", """
SELECT account, instrument, seq, c AS clamped, c - p AS delta, CASE WHEN c > p THEN 'buy' WHEN c < p THEN 'sell' END AS side, abs(c - p) AS qty,
  CASE WHEN c = target THEN 'Approved' ELSE 'Resized' END AS outcome FROM (
  SELECT *, coalesce(lag(c) OVER (PARTITION BY account, instrument ORDER BY t, seq), 0) AS p FROM (
    SELECT *, least(greatest(target, -3.0), 3.0) AS c FROM (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS target FROM fills)))""")
def _(s, d):
    return L.sized_orders(V.fills(s, d).withColumn("target", L.signed()), 3.0)


@query("l9_rejected_orders", "account instrument seq delta~4 side qty~4 outcome", """
WITH b AS (SELECT account, min(t) AS breach_t FROM (SELECT *, greatest(max(cash + value) OVER (PARTITION BY account ORDER BY t), 0) - cash - value AS fall FROM eq) WHERE fall >= 500 GROUP BY 1),
o AS (SELECT account, instrument, seq, t, target, c, c - coalesce(lag(c) OVER (PARTITION BY account, instrument ORDER BY t, seq), 0) AS m FROM (
  SELECT *, least(greatest(target, -3.0), 3.0) AS c FROM (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS target FROM fills))),
r AS (SELECT o.*, coalesce(t > breach_t, false) AS gone FROM o LEFT JOIN b ON b.account = o.account)
SELECT account, instrument, seq, CASE WHEN NOT gone THEN m END AS delta, CASE WHEN gone OR m = 0 THEN NULL WHEN m > 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN NOT gone THEN abs(m) END AS qty, CASE WHEN gone THEN 'Rejected' WHEN c = target THEN 'Approved' ELSE 'Resized' END AS outcome FROM r""", ctes=EQUITY)
def _(s, d):
    breaches = L.drawdown_breach(settle(equity(s, d)), 500.0)
    return L.sized_orders(V.fills(s, d).withColumn("target", L.signed()), 3.0, breaches=breaches)


@query("l10_carry_targets", "symbol t rate~10 market target~2", """
WITH h AS (SELECT symbol, t, funding_rate AS rate, coalesce(last_value(CASE WHEN funding_rate >= 0.0000503 THEN 2.0 WHEN funding_rate <= -0.0000503 THEN 0.0 END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS q FROM prints)
SELECT symbol, t, rate, 'spot' AS market, q AS target FROM h UNION ALL SELECT symbol, t, rate, 'futures', -q FROM h""")
def _(s, d):
    return L.carry_targets(V.prints(s, d), 0.0000503, -0.0000503, 2.0)


@query("l11_drawdown_breach", "account breach_t breach_fall~2", """
SELECT account, min(t) AS breach_t, arg_min(fall, t) AS breach_fall FROM (
  SELECT *, greatest(max(cash + value) OVER (PARTITION BY account ORDER BY t), 0) - cash - value AS fall FROM eq) WHERE fall >= 500 GROUP BY 1""", ctes=EQUITY)
def _(s, d):
    return L.drawdown_breach(settle(equity(s, d)), 500.0)


@query("l11_flatten_list", "account instrument breach_t position~4", f"""
SELECT f.account, f.instrument, b.breach_t, sum({SIGN} * qty) AS position FROM fills f JOIN (
  SELECT account, min(t) AS breach_t FROM (SELECT *, greatest(max(cash + value) OVER (PARTITION BY account ORDER BY t), 0) - cash - value AS fall FROM eq) WHERE fall >= 500 GROUP BY 1) b
ON b.account = f.account AND f.t <= b.breach_t GROUP BY 1, 2, 3 HAVING sum({SIGN} * qty) <> 0""", ctes=EQUITY)
def _(s, d):
    return L.flatten_list(V.fills(s, d), L.drawdown_breach(settle(equity(s, d)), 500.0))


@query("l12_thinned_equity", "account t equity~2", """
WITH RECURSIVE k AS (
  SELECT account, min(t) AS t FROM eq GROUP BY 1
  UNION ALL SELECT k.account, (SELECT min(e.t) FROM eq e WHERE e.account = k.account AND e.t >= k.t + 30) AS t FROM k
  WHERE (SELECT min(e.t) FROM eq e WHERE e.account = k.account AND e.t >= k.t + 30) IS NOT NULL)
SELECT k.account, k.t, e.cash + e.value AS equity FROM k JOIN eq e ON e.account = k.account AND e.t = k.t""", ctes=EQUITY)
def _(s, d):
    return L.thin(settle(equity(s, d)), 30 * DAY)
