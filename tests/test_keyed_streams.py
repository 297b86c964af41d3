"""Streams whose state lives with its key: results over several deliveries, restarts, and state that goes."""
import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import ledger as L
from tidemark.streaming import flows as T, keyed as K

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def deliver(spark, tmp_path):
    """Runs a stream once for each delivery, each time from its checkpoint; gives its rows and the state's rows after each."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(deliveries, make, at="t", lateness="0 seconds"):
        state = []
        for rows in deliveries:
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = make(T.folder(spark, f"{tmp_path}/in", rows.schema).withWatermark(at, lateness))
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            q.awaitTermination()
            state.append([o["numRowsTotal"] for o in q.recentProgress[-1]["stateOperators"]])
        return spark.read.parquet(f"{tmp_path}/out").collect(), state
    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_gaps_forget_idle_keys(spark, deliver):
    at = lambda *rows: spark.createDataFrame([(k, n, START + d * DAY) for k, n, d in rows], "key string, n bigint, t timestamp")
    got, state = deliver([at(("a", 1, 0), ("a", 2, 0), ("b", 10, 0), (None, 5, 0)), at(("a", 4, 1), ("b", 11, 1), (None, 6, 1)), at(("a", 5, 30)), at(("a", 6, 31), ("b", 90, 31)), at(("b", 92, 32))],
                         lambda s: K.gaps(s, ["key"], ["n"], "n", "t", 10 * 86_400_000))
    assert {(r.key, r.n): r.gap for r in got} == {("a", 1): False, ("a", 2): False, ("b", 10): False, (None, 5): False, ("a", 4): True, ("b", 11): False, (None, 6): False,
                                                  ("a", 5): False, ("a", 6): False, ("b", 90): False, ("b", 92): True}
    # After the third delivery only a is left; b was forgotten and begins anew.
    assert state[1][0] == state[0][0] > state[2][0]


def test_thinned_keys_need_no_state_after_their_interval(spark, deliver):
    rng = random.Random(4)
    stamps = {k: sorted(START + dt.timedelta(minutes=rng.randrange(0, 3 * 1440)) for _ in range(60)) for k in "abc"}
    stamps["c"] = [t for t in stamps["c"] if t < START + DAY]
    rows = [(k, t, i) for k, ts in stamps.items() for i, t in enumerate(ts)]
    days = [spark.createDataFrame([r for r in rows if (r[1] - START).days == d] + [("clock", START + (d + 1) * DAY, 0)], "key string, t timestamp, i int") for d in range(3)]
    got, state = deliver(days, lambda s: K.thinned(s, 90 * 60_000_000, ["key"], "t"))
    for k, ts in stamps.items():
        want, last = [], None
        for t in ts:
            if last is None or t - last >= dt.timedelta(minutes=90):
                want.append(t)
                last = t
        assert sorted(r.t for r in got if r.key == k) == want
    assert state[2][0] <= state[0][0]


def test_positions_drop_flat_slots(spark, deliver):
    rng = random.Random(9)
    fills = [("xyz"[rng.randrange(3)], rng.choice(["i", "j", None]), START + dt.timedelta(hours=n), n, rng.choice(["buy", "sell"]), float(rng.randrange(1, 4)), rng.random() * 10, 0.25) for n in range(90)]
    held = {}
    for a, i, _, _, side, q, *_ in fills:
        held[a, i] = held.get((a, i), 0) + (q if side == "buy" else -q)
    end = [(a, i, START + 10 * DAY, 1000 + n, "sell" if q > 0 else "buy", abs(q), 1.0, 0.0) for n, ((a, i), q) in enumerate(held.items()) if q]
    frame = lambda r: spark.createDataFrame(r, "account string, instrument string, t timestamp, seq bigint, side string, qty double, price double, fee double")
    got, state = deliver([frame(fills[:30]), frame(fills[30:]), frame(end)], K.positions)
    cash, position = {}, {}
    by_seq = {r.seq: r for r in got}
    for a, i, _, n, side, q, p, fee in sorted(fills + end, key=lambda f: f[3]):
        dq = q if side == "buy" else -q
        position[a, i], cash[a] = position.get((a, i), 0) + dq, cash.get(a, 0) - dq * p - fee
        assert by_seq[n].position == pytest.approx(position[a, i]) and by_seq[n].cash == pytest.approx(cash[a])
    assert len(got) == len(fills) + len(end) and state[2][0] == 3 < state[1][0]


def test_equity_with_late_marks_and_a_funding_print(spark, deliver):
    rng = random.Random(2)
    day = lambda n: (START + n * DAY).date()
    fills = [("ab"[n % 2], "uvw"[rng.randrange(3)], day(rng.randrange(40)), n, rng.choice(["buy", "sell"]), float(rng.randrange(1, 3)), 5 + rng.random(), 0.1) for n in range(50)]
    marks = [(i, day(n), 5 + rng.random(), "mark_kline") for i in "uvw" for n in range(1, 40, 3)]
    prints = [(i, day(n), rng.random() / 100) for i in "uv" for n in range(0, 40, 7)]
    f = spark.createDataFrame(fills, "account string, instrument string, t date, seq bigint, side string, qty double, price double, fee double")
    m = spark.createDataFrame(marks, "instrument string, t date, price double, kind string")
    p = spark.createDataFrame(prints, "instrument string, t date, rate double")
    events = reduce(DataFrame.unionByName, K.book_events(f, m, p)).cache()
    # Ten days a delivery, every third mark one delivery late; the last only moves time on.
    late = (F.col("kind") == "mark") & (F.dayofmonth("t") % 3 == 0)
    part = F.floor(F.datediff("t", F.lit(START.date())) / 10) + late.cast("int")
    clock = spark.createDataFrame([(None, START + 90 * DAY, "clock", None, None, None, None)], K.EVENTS)
    got, state = deliver([*[events.where(part == k) for k in range(5)], clock], K.equity, lateness="21 days")
    want = {(r.account, r.t): r for r in L.equity(f, m, p).collect()}
    mine = {(r.account, r.t.date()): r for r in got}
    assert len(mine) == len(got) and {(r[0], r[2]) for r in fills} <= set(mine) <= set(want)
    for k, r in mine.items():
        assert (r.cash, r.value, r.equity) == pytest.approx((want[k].cash, want[k].value, want[k].equity))
    # Nothing waits at the end but marks, holders and totals.
    assert state[-1][0] <= state[-2][0] and state[-1][1] < state[-2][1]


def test_thinned_calls_the_store_once_a_group_of_keys():
    import pandas as pd

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, v):
            self.held = v
        put = update

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.list, self.value = Value(), Value()
            self.list.held = []
        getListState = lambda self, *a: self.list
        getValueState = lambda self, *a: self.value
        registerTimer = deleteTimer = lambda self, at: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    rng = random.Random(3)
    rows = [(f"k{rng.randrange(200)}", START + dt.timedelta(minutes=m)) for m in range(3000)]
    handle, thin, got = Handle(), K.Thinned(90 * 60 * 10**9, "t", ["t", "key"]), []
    thin.init(handle)
    for part in (rows[:1500], rows[1500:]):
        frame = pd.DataFrame({"key": [k for k, _ in part], "t": [t for _, t in part], "key__": [k for k, _ in part]})
        for out in thin.handleInputRows((0,), iter([frame[:700], frame[700:]]), Clock()):
            got += list(zip(out["key"], out["t"].dt.to_pydatetime()))
    want, last = [], {}
    for k, t in rows:
        if k not in last or t - last[k] >= dt.timedelta(minutes=90):
            want.append((k, t))
            last[k] = t
    assert sorted(got) == sorted(want) and handle.list.calls == 2


def test_netted_events_are_one_row_a_stamp(spark):
    t = START
    rows = [("u", t, "fill", "a", 1.0, -5.0, None)] * 3 + [("u", t, "mark", None, None, None, p) for p in (4.0, 6.0)] + [("u", t, "print", None, None, None, p) for p in (0.25, 0.5, None)]
    got = K.netted(spark.createDataFrame(rows, K.EVENTS)).collect()
    assert {(r.kind, r.account, r.dq, r.dc) + ((r.price,) if r.kind != "fill" else ()) for r in got} == {
        ("fill", "a", 3.0, -15.0), ("mark", None, None, None, 6.0), ("print", None, None, None, 0.75)} and len(got) == 3
