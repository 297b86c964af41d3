import datetime as dt
import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as E, ledger as L
from tidemark.functions.columns import DAY, HOUR


@pytest.fixture(scope="module")
def bars(spark):
    def make(series, vol=0.01):
        rows = []
        for s, moves in series.items():
            for i, m in enumerate(moves):
                rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), m is not None, m, 0.0, vol, 1e6))
        return spark.createDataFrame(rows, "symbol string, at timestamp_ntz, traded boolean, held double, funding double, vol double, liquidity double")
    return make


def trig(spark, rows):
    full = [(f"{s}{h}", s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(side), float(st), 2.0) for s, h, side, st in rows]
    return spark.createDataFrame(full, "trade string, symbol string, at timestamp_ntz, side double, strength double, gap double")


def outcome(spark, bars, moves, exits, side=1):
    lv = E.path(bars({"A": moves}))
    r = E.outcomes(lv, trig(spark, [("A", 0, side, 1)]), exits).first()
    return (r.x, r.reason) if r else None


def test_barriers_and_their_precedence(spark, bars):
    ex = E.Barriers(target=2.0, stop=1.0, horizon=4)
    assert outcome(spark, bars, [0.0, 0.01, 0.01, 0.0, 0.0, 0.0], ex) == (2, "take")
    assert outcome(spark, bars, [0.0, -0.02, 0.05, 0.0, 0.0, 0.0], ex) == (1, "stop")
    assert outcome(spark, bars, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0], ex) == (4, "time")
    assert outcome(spark, bars, [0.0, 0.0, 0.0], ex) == (2, "end")
    assert outcome(spark, bars, [0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0], ex) == (5, "halt")
    # One bar at both a take and a revert is a take; a stop beats both.
    assert outcome(spark, bars, [0.0, 0.03, 0.0], E.Barriers(target=2.0, stop=None, horizon=2, fade=0.5)) == (1, "take")
    assert outcome(spark, bars, [0.0, -0.03, 0.0], E.Barriers(target=None, stop=1.0, horizon=2, fade=-5.0)) == (1, "stop")
    # A halted entry bar opens nothing; a delay fills later.
    assert outcome(spark, bars, [None, 0.0, 0.0], ex) is None
    assert outcome(spark, bars, [0.0, 0.05, 0.02, 0.0], E.Barriers(target=2.0, stop=None, horizon=2, wait=1)) == (2, "take")


def test_entry_on_the_last_bar_holds_nothing(spark, bars):
    lv = E.path(bars({"A": [0.0, 0.0]}))
    c = E.outcomes(lv, trig(spark, [("A", 1, 1, 1)]), E.Barriers(None, None, 3))
    assert E.marks(lv, c, 10).count() == 0 and c.first().reason == "end"


def undivided_walk(rows, slots, per_coin):
    open_all, open_by, taken = [], {}, set()
    for trade, sym, entry, leave, strength in sorted(rows, key=lambda r: (r[2], -abs(r[4]), r[0])):
        open_all = [x for x in open_all if x > entry]
        open_by[sym] = [x for x in open_by.get(sym, []) if x > entry]
        if len(open_by[sym]) < per_coin and len(open_all) < slots:
            open_all.append(leave)
            open_by[sym].append(leave)
            taken.add(trade)
    return taken


@pytest.mark.parametrize("seed,slots,per_coin,spread", [(1, 2, 1, 300), (2, 3, 2, 80), (3, 1, 1, 2000)])
def test_walk_equals_an_undivided_one(spark, seed, slots, per_coin, spread):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        e = rng.randrange(spread)
        rows.append((f"t{i:03}", rng.choice("ABC"), base + dt.timedelta(hours=e), base + dt.timedelta(hours=e + rng.randrange(0, 6)), rng.choice([1.0, 2.0, 3.0])))
    c = spark.createDataFrame(rows, "trade string, symbol string, entry timestamp, exit timestamp, strength double")
    got = {r.trade for r in E.admitted(c, slots, per_coin).collect()}
    assert got == undivided_walk(rows, slots, per_coin)


def test_thinning_is_greedy(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in rng.sample(range(5000), 900)]
    got = sorted((r.account, r.t) for r in L.thin(spark.createDataFrame(rows, "account string, t timestamp"), HOUR).collect())
    want, last = [], {}
    for k, t in sorted(rows):
        if k not in last or t - last[k] >= dt.timedelta(hours=1):
            last[k] = t
            want.append((k, t))
    assert got == want


def test_delta_neutral_round_trip(spark):
    """Reference 100, half spread 2 bps, fee 4 bps, funding 0.001: cash goes to -0.12, -0.02, -0.14."""
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    orders = spark.createDataFrame([(1, "spot", t(10), "buy", 1.0), (2, "perp", t(10), "sell", 1.0), (3, "spot", t(30), "sell", 1.0), (4, "perp", t(30), "buy", 1.0)],
                                   "order_id int, symbol string, t timestamp, side string, qty double")
    prices = spark.createDataFrame([("spot", t(1), 100.0), ("perp", t(1), 100.0)], "symbol string, t timestamp, price double")
    costs = spark.createDataFrame([(s, t(0), 2.0, 0.0, 4.0) for s in ("spot", "perp")],
                                  "symbol string, week_start timestamp, half_spread_bps double, impact_bps_per_unit double, taker_fee_bps double")
    done = L.price_with_costs(orders, prices, costs)
    fills = done.select(F.lit("acc").alias("account"), F.col("symbol").alias("instrument"), "t", F.col("order_id").alias("seq"), "side", "qty", F.col("fill").alias("price"), "fee")
    marks = spark.createDataFrame([("perp", t(2), 100.0, "mark_kline")], "instrument string, t timestamp, price double, kind string")
    funding = spark.createDataFrame([("perp", t(20), 0.001)], "instrument string, t timestamp, rate double")
    cash = {r.t: r.cash for r in L.equity(fills, marks, funding).collect()}
    assert abs(cash[t(10)] + 0.12) < 1e-9 and abs(cash[t(20)] + 0.02) < 1e-9 and abs(cash[t(30)] + 0.14) < 1e-9
    flows = L.funding_flows(fills, marks, funding).collect()
    assert [(r.instrument, round(r.received, 9), r.paid) for r in flows] == [("perp", 0.1, 0.0)]


def test_orders_without_price_or_cost_are_rejected(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    orders = spark.createDataFrame([(1, "a", t(0), "buy", 1.0), (2, "a", t(2), "buy", 1.0), (3, "a", t(9), "buy", 1.0)], "order_id int, symbol string, t timestamp, side string, qty double")
    prices = spark.createDataFrame([("a", t(1), 10.0)], "symbol string, t timestamp, price double")
    costs = spark.createDataFrame([("a", t(5), 1.0, 0.0, 1.0)], "symbol string, week_start timestamp, half_spread_bps double, impact_bps_per_unit double, taker_fee_bps double")
    assert {r.order_id: r.reason for r in L.price_with_costs(orders, prices, costs).collect()} == {1: "NoPriceAvailable", 2: "NoCostAvailable", 3: None}


def test_carry_holds_between_its_thresholds(spark):
    rows = [("a", dt.date(2024, 1, i + 1), r) for i, r in enumerate([0.0, 0.5, 0.2, 0.05, 0.2, 0.6])]
    out = L.carry_targets(spark.createDataFrame(rows, "symbol string, t date, funding_rate double"), 0.4, 0.1, 3.0)
    spot = [r.target for r in out.filter("market = 'spot'").orderBy("t").collect()]
    assert spot == [0.0, 3.0, 3.0, 0.0, 0.0, 3.0]


def test_breach_is_the_first_fall_from_a_peak_that_starts_at_zero(spark):
    rows = [("a", dt.date(2024, 1, i + 1), float(e)) for i, e in enumerate([-3, 5, 1, -1, 9, 0])] + [("b", dt.date(2024, 1, 1), -7.0)]
    out = {r.account: (r.breach_t.day, r.breach_fall) for r in L.drawdown_breach(spark.createDataFrame(rows, "account string, t date, equity double"), 5.0).collect()}
    assert out == {"a": (4, 6.0), "b": (1, 7.0)}
