"""The weekly cost table CSV: columns by name in any order; a bad row of a known symbol fails the job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REQUIRED = ("symbol", "market", "week_start", "half_spread_bps", "impact_bps_per_unit", "taker_fee_bps")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"cost table lacks {missing}")
    return rows


def typed(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """Typed rows of known (symbol, market) pairs; unknown symbols are left out, blank impact is 0, other bad fields fail."""
    def must(value: Column, what: str) -> Column:
        return F.when(value.isNotNull(), value).otherwise(
            F.raise_error(F.concat(F.lit(f"cost table has a bad {what} for "), F.coalesce("symbol", F.lit("?")))).cast("double"))

    def number(c):
        return F.when(F.col(c) != "", F.col(c)).try_cast("double")

    market = F.col("market").try_cast("int")
    bad_market = F.raise_error(F.concat(F.lit("cost table has a bad market "), F.coalesce("market", F.lit("")))).cast("int")
    known = rows.withColumn("market", F.when(market.isNotNull(), market).otherwise(bad_market))
    known = known.join(instruments.select("symbol", "market").distinct(), ["symbol", "market"], "left_semi")
    day = F.col("week_start").try_cast("date")
    bad_day = F.raise_error(F.concat(F.lit("cost table has a bad week_start "), F.coalesce("week_start", F.lit("")))).cast("date")
    blank = F.coalesce(F.col("impact_bps_per_unit"), F.lit("")) == ""
    return known.select("symbol", "market", F.when(day.isNotNull(), day).otherwise(bad_day).alias("week_start"),
                        must(number("half_spread_bps"), "half_spread_bps").alias("half_spread_bps"),
                        F.when(blank, F.lit(0.0)).otherwise(must(number("impact_bps_per_unit"), "impact_bps_per_unit")).alias("impact_bps_per_unit"),
                        must(number("taker_fee_bps"), "taker_fee_bps").alias("taker_fee_bps"))
