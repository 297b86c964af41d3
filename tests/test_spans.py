"""Interval joins against every pair."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY
from tidemark.operators import ledger as L, spans as S

DATE = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("opening", [True, False])
def test_during_equals_every_pair(spark, opening):
    rng = random.Random(7)
    spans = [(rng.choice(["a", "b", None]), i, DATE(s := rng.randrange(200)), rng.choice([None, DATE(s), DATE(s + rng.randrange(1, 120))])) for i in range(60)] + [("a", 99, None, DATE(5))]
    points = [(rng.choice(["a", "b", "c", None]), n, None if n == 3 else DATE(rng.randrange(220))) for n in range(80)]
    want = sorted((n, i) for k, i, s, u in spans for p, n, t in points if k is not None and k == p and s and t
                  and (s <= t and (u is None or t < u) if opening else s < t and (u is None or t <= u)))
    df = spark.createDataFrame(spans, "k string, i int, since date, until date")
    pts = spark.createDataFrame(points, "k string, n int, t date")
    for width in (7 * DAY, 500 * DAY):
        got = S.during(df, pts, ["k"], "t", opening=opening, width=width)
        assert sorted((r.n, r.i) for r in got.collect()) == want and got.columns == ["k", "n", "t", "i"]


def test_joined_rows_follow_what_is_held(spark):
    """Thousands of marks of an instrument that two slots hold for days: no row for the others, none while flat."""
    fills = [("x", "i", DATE(10), 1, "buy", 2.0, 5.0), ("x", "i", DATE(13), 2, "sell", 2.0, 5.0), ("y", "i", DATE(20), 3, "sell", 1.0, 5.0), ("y", "i", DATE(22), 4, "buy", 1.0, 5.0)]
    fills += [("z", f"o{n}", DATE(n), 10 + n, "buy", 1.0, 5.0) for n in range(5)]
    f = spark.createDataFrame(fills, "account string, instrument string, t date, seq bigint, side string, qty double, price double")
    marks = spark.range(4000).select(F.lit("i").alias("instrument"), F.date_add(F.lit(DATE(0)), F.col("id").cast("int")).alias("t"), (F.col("id") % 7 + 1.0).alias("price"), F.lit("mark_kline").alias("kind"))
    eq = {(r.account, r.t): r for r in L.equity(f, marks).collect()}
    assert set(eq) == {("x", DATE(n)) for n in range(10, 14)} | {("y", DATE(n)) for n in range(20, 23)} | {("z", DATE(n)) for n in range(5)}
    assert [eq["x", DATE(n)].value for n in range(10, 14)] == [2.0 * (n % 7 + 1) for n in range(10, 13)] + [0.0]
    prints = spark.createDataFrame([("i", DATE(n), 0.5) for n in (9, 10, 12, 13, 21)], "instrument string, t date, rate double")
    got = {(r.account, r.t): r.flow for r in L.funding_flows(f, marks, prints).collect()}
    assert got == {("x", DATE(10)): 2.0 * 3 * 0.5, ("x", DATE(12)): 2.0 * 5 * 0.5, ("y", DATE(21)): -1.0 * 7 * 0.5}
