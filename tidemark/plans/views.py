"""The driver tables seen as market data: bars, funding prints, trades, orders, fills, marks, cost rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import week_start
from ..session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark, sf_dir) -> DataFrame:
    """(symbol, at, high, low, close, volume): daily bars per brand; returned items have no volume, so idle days occur."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (l.join(p, "l_partkey").groupBy("symbol", F.col("l_shipdate").cast("date").alias("at"))
            .agg(F.max(unit).alias("high"), F.min(unit).alias("low"),
                 (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                 F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))).alias("volume")))


def stored_bars(spark, sf_dir) -> DataFrame:
    """bars, written once, for plans that read them more than once: the line items are scanned once."""
    return settle(bars(spark, sf_dir))


def prints(spark, sf_dir) -> DataFrame:
    """(symbol, t, funding_rate): funding prints, two days after shipping, so some fall where no bar is."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_discount")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return (l.join(p, "l_partkey").groupBy("symbol", F.date_add(F.col("l_shipdate").cast("date"), 2).alias("t"))
            .agg((F.avg(F.col("l_discount") - 0.05) / 100).alias("funding_rate")))


def trades(spark, sf_dir) -> DataFrame:
    """(id, symbol, ts, price, qty, side): a user's events as trades; error events are rejects and left out."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"), "ts",
                    F.col("value").alias("price"), F.lit(1.0).alias("qty"),
                    F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell").alias("side"))


def brand_of(key: Column) -> Column:
    """A brand for a key, spread over all 25."""
    return F.concat(F.lit("Brand#"), ((key % 5) + 1).cast("string"), ((F.floor(key / 5) % 5) + 1).cast("string"))


def orders(spark, sf_dir) -> DataFrame:
    """(order_id, symbol, account, t, side, qty): orders to price, on a brand by order key."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("account"))
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("order_id"), brand_of(F.col("o_orderkey")).alias("symbol"), "account",
        F.col("o_orderdate").cast("date").alias("t"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"),
        (F.col("o_totalprice") / 10000).alias("qty"))


def fills(spark, sf_dir) -> DataFrame:
    """(account, instrument, t, seq, side, qty, price, fee): orders as fills per market segment and nation."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("account"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("instrument"))
    qty = (F.col("o_orderkey") % 5 + 1).cast("double")
    price = F.col("o_totalprice") / 1000
    return o.join(c, "o_custkey").join(n, "c_nationkey").select(
        "account", "instrument", F.col("o_orderdate").cast("date").alias("t"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), qty.alias("qty"), price.alias("price"),
        (qty * price * 0.0004).alias("fee"))


def marks(spark, sf_dir) -> DataFrame:
    """(instrument, t, price, kind): weekly mark bars per nation, the mean order price of the week, at its end."""
    f = fills(spark, sf_dir)
    return (f.groupBy("instrument", F.date_add(week_start("t"), 6).alias("t")).agg(F.avg("price").alias("price"))
            .withColumn("kind", F.lit("mark_kline")))


def nation_funding(spark, sf_dir) -> DataFrame:
    """(instrument, t, rate): a funding print per nation on the day after each month, signed."""
    f = fills(spark, sf_dir)
    return f.groupBy("instrument", F.date_add(F.last_day("t"), 1).alias("t")).agg(((F.avg("qty") - 3) / 1000).alias("rate"))


def cost_rows(spark, sf_dir) -> DataFrame:
    """(symbol, week_start, half_spread_bps, impact_bps_per_unit, taker_fee_bps): monthly cost rows per brand, in force a year later, so the first orders have none."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_tax", "l_discount")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    day = F.col("l_shipdate").cast("date")
    return (l.join(p, "l_partkey").groupBy("symbol", F.add_months(F.trunc(day, "month"), 12).alias("week_start"))
            .agg((F.avg("l_tax") * 100).alias("half_spread_bps"), F.avg("l_discount").alias("impact_bps_per_unit"),
                 F.lit(5.0).alias("taker_fee_bps")))
