import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import ordinals, previous, scan


@pytest.fixture(scope="module")
def skewed():
    """One key holds most of the rows."""
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"k": key, "t": rng.integers(0, 500, n), "id": np.arange(n), "x": rng.normal(size=n).round(3)}
                        ).assign(x=lambda d: d.x.where(rng.random(n) > 0.2))


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_scan_equals_a_plain_running_value_at_any_block_width(spark, skewed, width):
    df = spark.createDataFrame(skewed)
    x = F.when(~F.isnan("x"), F.col("x"))
    got = scan(df.withColumn("x", x), ["k"], ["t", "id"], F.floor(F.col("t") / width), sums={"s": F.col("x")}, maxes={"m": F.col("x")},
               lasts={"l": F.col("x")}, before={"s0": "s", "l0": "l"}).toPandas().sort_values("id")
    want = skewed.sort_values(["t", "id"])
    g = want.groupby("k").x
    want = want.assign(s=g.transform(lambda v: v.fillna(0).cumsum()), m=g.transform(lambda v: v.cummax().ffill()), l=g.transform("ffill"))
    want["s0"] = want.s - want.x.fillna(0)
    want["l0"] = want.groupby("k").l.shift()
    want = want.sort_values("id")
    for c in ("s", "m", "l", "s0", "l0"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_previous_keeps_a_null_of_the_row_before(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0)], "k string, t int, x double")
    out = previous(df, ["k"], ["t"], F.col("t"), {"p": F.col("x")}).orderBy("t").collect()
    assert [r.p for r in out] == [None, 5.0, None]


def test_ordinals_number_distinct_stamps(spark):
    df = spark.createDataFrame([(t,) for t in (5, 1, 9, 5, 100, 2)], "t int")
    out = {r.t: r.bar for r in ordinals(df, "t", F.floor(F.col("t") / 4)).collect()}
    assert out == {1: 1, 2: 2, 5: 3, 9: 4, 100: 5}


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
@pytest.mark.parametrize("block", [3, 1000])
def test_asof_equals_merge_asof(spark, direction, strict, block):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.choice(["hot", "hot", "b"], 800), "t": rng.integers(0, 300, 800), "i": range(800)})
    right = pd.DataFrame({"k": rng.choice(["hot", "hot", "b"], 200), "u": rng.integers(0, 300, 200)}).drop_duplicates().assign(v=lambda d: range(len(d)))
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", {"v": "v"}, direction, block, strict=strict)
    got = got.toPandas().sort_values("i").v.astype(float).to_numpy()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", direction=direction,
                         allow_exact_matches=not strict).sort_values("i").v.astype(float).to_numpy()
    np.testing.assert_array_equal(got, want)


def test_null_keys_and_stamps_keep_their_rows(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, None), (None, 3, 5), (None, 4, None)], "k string, id int, t bigint").selectExpr("k", "id", "timestamp_seconds(t) AS t")
    right = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), ("a", None, 3.0)], "k string, t bigint, v double").selectExpr("k", "timestamp_seconds(t) AS t", "v")
    for direction, first in (("backward", 1.0), ("forward", None)):
        got = {r.id: r.v for r in asof_join(left, right, ["k"], "t", "t", {"v": "v"}, direction).collect()}
        assert got == {1: first, 2: None, 3: None, 4: None}
    df = spark.createDataFrame([(None, 1, 2), (None, 70, 3), ("a", None, 5), ("a", 2, 7)], "k string, t bigint, x bigint")
    out = {(r.k, r.t): (r.s, r.p) for r in scan(df, ["k"], ["t"], F.floor(F.col("t") / 64), sums={"s": F.col("x")}, lasts={"l": F.col("x")}, before={"p": "l"}).collect()}
    assert out == {(None, 1): (2, None), (None, 70): (5, 2), ("a", None): (5, None), ("a", 2): (12, 5)}
