"""Sliding quantiles: brute force over ties, gaps, nulls and batch edges; a hot key over many blocks; the cost of long frames."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B, panel as P
from tidemark.operators.quantiles import LOAD, Multiset, trailing

ROWS = "k string, o bigint, x double, __tag string"


def made(n, seed=3):
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 40])
        x = rng.choice([None, float("nan"), 0.5, round(rng.gauss(0, 1), 3), rng.gauss(0, 1)])
        out.append((rng.choice(["a", "a", "a", None, "b"]), rng.choice([at] * 30 + [None]), x, f"r{i}"))
    return out


def expected(rows, q, least, span, inclusive):
    out = {}
    for k, o, _, tag in rows:
        seen = [] if o is None else [x for j, p, x, _ in rows if j == k and p is not None and x is not None and x == x
                                     and (p <= o if inclusive else p < o) and (span is None or p > o - span)]
        out[tag] = float(np.quantile(seen, q)) if o is not None and len(seen) >= least else None
    return out


def test_multiset_equals_a_sorted_list():
    rng, m, plain = random.Random(1), Multiset(), []
    for _ in range(8 * LOAD):
        v = float(rng.randrange(300))
        m.add(v)
        plain.append(v)
        if rng.random() < 0.45:
            gone = plain.pop(rng.randrange(len(plain)))
            m.drop(gone)
    plain.sort()
    assert [m.rank(i) for i in range(m.n)] == plain and m.quantile(0.3) == pytest.approx(np.quantile(plain, 0.3))
    for v in plain:
        m.drop(v)
    assert m.n == 0 and not m.parts


@pytest.mark.parametrize("span,inclusive", [(None, True), (None, False), (7, True), (7, False), (1, True), (60, False)])
def test_trailing_equals_brute_force(spark, span, inclusive):
    rows = made(400)
    df = spark.createDataFrame(rows, ROWS)
    # Batches of a few rows cut runs of one order.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = trailing(df, ["k"], F.col("o"), "x", {"lo": 0.25, "hi": 0.9}, 2, span, inclusive).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and got[0].asDict().keys() == {"k", "o", "x", "__tag", "lo", "hi"}
    for name, q in (("lo", 0.25), ("hi", 0.9)):
        want = expected(rows, q, 2, span, inclusive)
        assert {r["__tag"]: r[name] for r in got} == {t: v if v is None else pytest.approx(v, abs=1e-12) for t, v in want.items()}


def test_no_rows_and_no_keys(spark):
    none = spark.createDataFrame([], ROWS)
    assert trailing(none, ["k"], F.col("o"), "x", {"q": 0.5}, span=3).collect() == []
    some = spark.createDataFrame([("a", 1, 1.0, ""), ("b", 2, 3.0, "")], ROWS)
    assert sorted(r.q for r in trailing(some, [], F.col("o"), "x", {"q": 0.5}).collect()) == [1.0, 2.0]


def test_a_hot_key_spreads_over_blocks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 97).cast("double").alias("x"), F.lit("").alias("__tag"))
    placed = trailing(df, ["k"], F.col("o"), "x", {"q": 0.5}, span=250).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in placed) == 20_000 and max(r["count"] for r in placed) < 12_000


def test_long_frames_grow_with_the_rows(spark):
    def took(n):
        df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.rand(1).alias("x"), F.lit("").alias("__tag"))
        t = time.time()
        trailing(df, ["k"], F.col("o"), "x", {"q": 0.5}, 1).write.format("noop").mode("overwrite").save()
        return time.time() - t
    took(100)
    small, large = took(15_000), took(60_000)
    # A sort for every row would take sixteen times as long or more.
    assert large < 10 * small + 1


def test_fine_bars_give_what_sorting_gives(spark):
    rows = [(s, m, float((m * 7919 + len(s)) % 101)) for s in ("x", "yy") for m in range(900) if m % 13]
    b = spark.createDataFrame(rows, "symbol string, m bigint, dollar_volume double").withColumn("at", F.timestamp_micros(F.col("m") * 60_000_000))
    sort = lambda d: sorted((r.symbol, r.m, r.liquidity) for r in d.collect())
    assert sort(B.with_liquidity(b, 300 * 60_000_000, 20)) == sort(B.with_liquidity(b, 300 * 60_000_000, 20, fine=True))


def test_long_panels_slide(spark, monkeypatch):
    rows = [(s, i, float((i * 31 + len(s)) % 17 + 1)) for s in ("x", "yy") for i in range(80) if (i + len(s)) % 9]
    b = spark.createDataFrame(rows, "symbol string, i int, volume double").select(
        "symbol", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("at"), F.col("volume").alias("close"), "volume")
    b = B.with_dollar_volume(B.long_bars(b))
    out = lambda: sorted((r.symbol, r.bar, r["__liq"]) for r in P.rolled_bars(b, 30, 5).select("symbol", "bar", "__liq").collect())
    plain = out()
    monkeypatch.setattr(P, "SORTED", 0)
    assert out() == plain
