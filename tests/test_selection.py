"""Exact medians by selection against sorting."""
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs as C, selection


@pytest.mark.parametrize("fits", [40, 10_000])
def test_medians_of_hot_tied_and_odd_groups(spark, fits):
    rng = random.Random(11)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(5001)], "even": [rng.gauss(0, 1) for _ in range(1000)], "heavy": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(3000)],
              "tied": [1.0] * 2000 + [rng.random() for _ in range(900)] + [2.0 + rng.random() for _ in range(900)], "equal": [3.0] * 700, "two": [1.0] * 300 + [2.0] * 300, None: [rng.random() for _ in range(300)],
              "few": [5.0, 1.0], "one": [-0.0], "none": [None, None], "nan": [1.0, float("nan"), float("nan")], "gaps": [None] * 500 + [rng.random() for _ in range(501)]}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(7).withColumn("n", F.lit("n")).cache()
    got = {r.k: r for r in selection.medians(df, ["k"], F.col("x"), "m", fits=fits).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        values = [x for x in xs if x is not None]
        want = None if not values else float("nan") if k == "nan" else statistics.median(values)
        assert (got[k].n, got[k].rows) == (len(values), len(xs))
        assert got[k].m == want or (math.isnan(want) and math.isnan(got[k].m)), k
    assert selection.medians(df.limit(0), ["k"], F.col("x")).collect() == []


def test_impact_looks_back_over_hours(spark):
    """The trade before may be hours ago; the first of a day has none, and one without quantity gives nothing."""
    rows = [(1, "a", "2024-01-01 00:10:00", 100.0, 2.0), (2, "a", "2024-01-01 09:59:59", 101.0, 0.0), (3, "a", "2024-01-01 23:00:00", 99.0, 4.0), (4, "a", "2024-01-01 23:00:00", 98.0, 1.0),
            (5, "a", "2024-01-02 00:00:00", 50.0, 1.0), (6, "b", "2024-01-01 00:00:00", 50.0, 1.0), (7, "b", "2024-01-01 05:00:00", 60.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, symbol string, ts string, price double, qty double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.symbol, r.day.day): (r.impact_bps_per_unit, r.n_trades) for r in C.impact_per_unit(df).collect()}
    step = lambda a, b, q: abs(math.log(b) - math.log(a)) / q * 1e4
    assert set(got) == {("a", 1), ("b", 1)} and got["a", 1] == (pytest.approx((step(100, 101, 2) + step(99, 98, 4)) / 2), 4) and got["b", 1] == (pytest.approx(step(50, 60, 1)), 2)


def test_impact_of_a_price_of_zero_is_infinite(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 9, n)
    prices = {"a": [2.0, 0.0], "b": [1.0, 0.0, 4.0], "c": [1.0, 2.0, 0.0], "d": [1.0, 2.0, 4.0, 0.0], "e": [0.0, 0.0], "f": [1.0, None]}
    df = spark.createDataFrame([(n, s, at(n), p, 1.0) for s, ps in prices.items() for n, p in enumerate(ps)], "id bigint, symbol string, ts timestamp, price double, qty double")
    got = {r.symbol: r.impact_bps_per_unit for r in C.impact_per_unit(df).collect()}
    assert math.isnan(got.pop("e"))
    assert got == {"a": math.inf, "b": math.inf, "c": math.inf, "d": pytest.approx(1e4 * math.log(2))}
