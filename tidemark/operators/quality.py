"""Data-quality accounting and ingestion planning: tables about tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DAY, micros
from .grid import islands
from .ordered import previous

# Base assets that are not coins, and the leveraged-token pattern.
NOT_COINS = ("USDC", "TUSD", "PAX", "BUSD", "USDS", "USDSB", "USDP", "DAI", "FDUSD", "UST", "EUR", "GBP", "AUD", "PAXG", "XAUT")
LEVERAGED = "(UP|DOWN|BULL|BEAR)USDT$"
# Days after which daily files, and further days after which monthly files, are published.
DAILY_LAG, MONTHLY_LAG = 1, 7


def stamp_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], stamp: str, block: Column) -> DataFrame:
    """Adds backwards and repeated: the stamp is before, or equals, the stream's row before in file order."""
    r = previous(rows, keys, order, block, {"__p": F.col(stamp)})
    return (r.withColumn("backwards", F.coalesce(F.col(stamp) < F.col("__p"), F.lit(False)))
            .withColumn("repeated", F.coalesce(F.col(stamp) == F.col("__p"), F.lit(False))).drop("__p"))


def sequence_gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, block: Column) -> DataFrame:
    """Adds gap: the number is not the stream's number before plus one. Repeats and steps back count, the first row never."""
    r = previous(rows, keys, order, block, {"__p": F.col(number)})
    return r.withColumn("gap", F.coalesce(F.col(number) != F.col("__p") + 1, F.lit(False))).drop("__p")


def expected_rows(files: DataFrame) -> DataFrame:
    """Adds expected: the bars a file's span holds, from span (day or month), start and bar width in seconds; 0 where unknown."""
    days = F.when(F.col("span") == "day", F.lit(1)).otherwise(F.dayofmonth(F.last_day("start")))
    n = F.floor(days * F.lit(86400) / F.col("width_seconds"))
    return files.withColumn("expected", F.coalesce(F.when(F.col("width_seconds") > 0, n), F.lit(0)).cast("bigint"))


def missing_days(bars: DataFrame, day: str = "day") -> DataFrame:
    """(symbol, day): days between a symbol's first and last bar with no bar."""
    have = bars.select("symbol", day).distinct()
    span = have.groupBy("symbol").agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return span.join(have, ["symbol", day], "left_anti")


def missing_runs(bars: DataFrame, day: str = "day") -> DataFrame:
    return islands(missing_days(bars, day), ["symbol"], day)


def backfill(primary: DataFrame, fill: DataFrame, keys: Sequence[str] = ("symbol", "open_time")) -> DataFrame:
    """primary with rows of fill where it has none; one row per key, primary first."""
    rest = [c for c in primary.columns if c not in keys]
    both = (primary.withColumn("__p", F.lit(0)).unionByName(fill.select(*primary.columns).withColumn("__p", F.lit(1))))
    pick = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__p", *rest)).alias("__r"))
    return pick.select(*keys, "__r.*").select(*primary.columns)


def fetch_plan(requests: DataFrame) -> DataFrame:
    """requests (id, cadence daily|monthly|both, start, end, now) to fetch windows (id, kind, lo, hi, through).

    Monthly files cover what is published of them, daily files the rest;
    through is the day the result is complete to. Dates throughout.
    """
    r = requests.withColumn("__d", F.date_sub("now", DAILY_LAG))
    r = r.withColumn("__m", F.trunc(F.date_sub("__d", MONTHLY_LAG), "month"))
    daily_only, both = F.col("cadence") == "daily", F.col("cadence") == "both"
    r = r.withColumn("__mh", F.when(daily_only, F.col("start")).otherwise(F.greatest(F.col("start"), F.least("end", "__m"))))
    r = r.withColumn("__dh", F.when(daily_only | both, F.greatest(F.col("__mh"), F.least("end", "__d"))).otherwise(F.col("__mh")))
    windows = F.array(F.struct(F.lit("Monthly").alias("kind"), F.col("start").alias("lo"), F.col("__mh").alias("hi")),
                      F.struct(F.lit("Daily").alias("kind"), F.col("__mh").alias("lo"), F.col("__dh").alias("hi")))
    live = F.filter(windows, lambda w: w["lo"] < w["hi"])
    return (r.select("id", F.col("__dh").alias("through"), F.explode_outer(live).alias("w"))
            .select("id", "w.kind", "w.lo", "w.hi", "through"))


def stale_partitions(wanted: DataFrame, manifest: DataFrame, need: Column) -> DataFrame:
    """(parts, symbols): partitions to refetch, symbols grouped by their identical list of them.

    wanted: (symbol, part, part_end); manifest: (symbol, part, through). A
    partition is stale unless complete through the lesser of its end and need.
    """
    j = wanted.join(manifest.select("symbol", "part", "through"), ["symbol", "part"], "left")
    stale = j.filter(F.col("through").isNull() | (F.col("through") < F.least("part_end", need)))
    lists = stale.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"))
    return lists.groupBy("parts").agg(F.count(F.lit(1)).alias("symbols"), F.min("symbol").alias("first_symbol"),
                                      F.max("symbol").alias("last_symbol"))


def period_partitions(spans: DataFrame, unit: str = "month") -> DataFrame:
    """Calendar partitions covering each [start, end): (…, part_start, part_end, label)."""
    step = F.expr(f"interval 1 {unit}")
    first = F.trunc("start", unit)
    last = F.trunc(F.date_sub("end", 1), unit)
    out = spans.withColumn("part_start", F.explode(F.sequence(first, last, step)))
    months = 1 if unit == "month" else 12
    label = F.date_format("part_start", "'year='yyyy'/month='MM" if unit == "month" else "'year='yyyy")
    return out.withColumn("part_end", F.add_months("part_start", months)).withColumn("label", label)


def inventory(manifest: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Partitions, rows, gigabytes and last read per dataset."""
    return manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("partitions"), F.sum("rows").alias("rows"),
                                       (F.sum("bytes") / F.lit(1e9)).alias("gb"), F.max("last_read").alias("last_read"))


def unique_bars(bars: DataFrame, keys: Sequence[str] = ("symbol", "at")) -> DataFrame:
    """bars, failing the job where a key has more than one row."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    guard = F.when(n > 1, F.raise_error(F.concat(F.lit("more than one bar for "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])))
                   .cast("bigint")).otherwise(n)
    return bars.withColumn("__n", guard).filter(F.col("__n") == 1).drop("__n")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: keys only in a, only in b, in both, and the largest relative gap of value."""
    j = (a.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__ia"))
         .join(b.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__ib")), list(keys), "full_outer"))
    return j.agg(F.count_if(F.col("__ib").isNull()).alias("left_only"), F.count_if(F.col("__ia").isNull()).alias("right_only"),
                 F.count_if(F.col("__ia").isNotNull() & F.col("__ib").isNotNull()).alias("shared"),
                 F.max(F.abs(F.col("__a") / F.col("__b") - 1)).alias("max_gap"))


def perps(listed: DataFrame, non_crypto: DataFrame | None = None) -> DataFrame:
    """Listed symbols that are perpetuals in USDT, without the non-crypto ones when given."""
    p = listed.filter(F.endswith("symbol", F.lit("USDT")) & ~F.contains("symbol", F.lit("_")))
    return p.join(non_crypto.select("symbol"), "symbol", "left_anti") if non_crypto is not None else p


def spot_pairs(listed: DataFrame, not_coins: Sequence[str] = NOT_COINS) -> DataFrame:
    """Listed spot pairs in USDT that are coins: ascii, not a stable, fiat or gold base, not leveraged."""
    base = F.expr("substring(symbol, 1, length(symbol) - 4)")
    return listed.filter(F.endswith("symbol", F.lit("USDT")) & ~F.rlike("symbol", F.lit("[^\\x00-\\x7F]"))
                         & ~base.isin(*not_coins) & ~F.rlike("symbol", F.lit(LEVERAGED)))


def census(panel: DataFrame, bars: DataFrame, floor: float) -> DataFrame:
    """(year, trading, tradeable): mean coins per week that traded, and that had a return with liquidity of at least floor."""
    from ..functions.columns import week_end
    t = (bars.groupBy("symbol", week_end("at").alias("period")).agg(F.max(F.col("traded").cast("int")).alias("t"))
         .groupBy("period").agg(F.sum("t").alias("trading")))
    p = panel.groupBy("period").agg(F.count_if(F.col("returns").isNotNull() & (F.col("liquidity") >= floor)).alias("tradeable"))
    j = t.join(p, "period", "left")
    return (j.groupBy(F.year("period").cast("bigint").alias("year"))
            .agg(F.avg("trading").alias("trading"), F.avg(F.coalesce("tradeable", F.lit(0))).alias("tradeable")))


def delisted(bars: DataFrame, quiet_days: int = 14) -> DataFrame:
    """(symbol, last_trade, frozen_days, stopped): symbols that stopped trading before the end less quiet_days."""
    end = bars.agg(F.max("at")).scalar()
    s = bars.groupBy("symbol").agg(F.max(F.when(F.col("traded"), F.col("at"))).alias("last_trade"),
                                   F.count_if(~F.col("traded")).alias("frozen_days"))
    return s.withColumn("stopped", F.col("last_trade") < F.date_sub(end, quiet_days))
