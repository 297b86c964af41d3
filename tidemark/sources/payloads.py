"""JSON payloads to rows: parallel-array bars and instrument tags."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BARS = "timestamp array<bigint>, adjclose array<double>, volume array<double>"
INFO = "symbols array<struct<symbol:string, contractType:string, underlyingSubType:array<string>>>"


def array_bars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(symbol, at, close, volume) from {timestamp[], adjclose[], volume[]}: no null close, the day's first row, volume 0 where null."""
    j = payloads.withColumn("__j", F.from_json(column, BARS))
    rows = j.select("symbol", F.posexplode(F.arrays_zip("__j.timestamp", "__j.adjclose", "__j.volume")).alias("n", "r"))
    rows = (rows.filter(F.col("r.adjclose").isNotNull())
            .select("symbol", F.to_date(F.timestamp_seconds("r.timestamp")).alias("at"), "n",
                    F.col("r.adjclose").alias("close"), F.coalesce("r.volume", F.lit(0.0)).alias("volume")))
    return (rows.groupBy("symbol", "at").agg(F.min_by(F.struct("close", "volume"), "n").alias("r"))
            .select("symbol", "at", "r.close", "r.volume"))


def non_crypto(infos: DataFrame, column: str = "payload") -> DataFrame:
    """Symbols whose tags say the underlying is not crypto."""
    s = infos.select(F.explode(F.from_json(column, INFO)["symbols"]).alias("s"))
    tagged = (F.col("s.contractType") == "TRADIFI_PERPETUAL") | F.array_contains("s.underlyingSubType", "RWA")
    return s.filter(F.coalesce(tagged, F.lit(False))).select(F.col("s.symbol").alias("symbol")).distinct()
