"""Operators over streams.

Windowed bars use Spark's own watermarked aggregation. What needs a running
value per key runs the batch operator on each micro-batch, with the state of
the batch before stacked in front as rows, and writes the state after it to a
folder per epoch. A hot key is then cut into blocks of time as in batch,
and a replayed epoch reads the same state and overwrites the same output.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import micros
from ..operators import bars as B, ledger as L, quality as Q
from ..operators.ordered import scan


def folder(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.parquet(path)


def merged(streams: Sequence[DataFrame], at: str, lateness: str) -> DataFrame:
    """One stream of many that waits for its slowest: event time only moves as far as every stream has come."""
    spark = streams[0].sparkSession
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    out = streams[0].withWatermark(at, lateness)
    for s in streams[1:]:
        out = out.unionByName(s.withWatermark(at, lateness), allowMissingColumns=True)
    return out


def replay_order(kind: Column, at: str = "ts", stream: str = "stream") -> list[Column]:
    """The total order of merged events: stamp, bars after everything else, then the stream."""
    return [F.col(at), kind.isin("kline", "mark_kline", "premium_kline").cast("int"), F.col(stream)]


def of_kinds(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Events of the given kinds, dropped before any shuffle."""
    return events.filter(F.col("kind").isin(*kinds))


def ohlcv(trades: DataFrame, width: str, lateness: str, at: str = "ts") -> DataFrame:
    """Bars per symbol and window, final once the watermark passes their close; t, the close, is when a bar is known."""
    return B.ohlcv(trades.withWatermark(at, lateness), width, at)


def side_buckets(trades: DataFrame, width: str, lateness: str, at: str = "ts") -> DataFrame:
    """Per symbol and window: price sums and counts of each aggressor side, what effective spreads are made of."""
    buy = F.col("side") == "buy"
    return (trades.withWatermark(at, lateness).groupBy("symbol", F.window(at, width).alias("w"))
            .agg(F.sum(F.when(buy, F.col("price"))).alias("buy_sum"), F.count_if(buy).alias("buys"),
                 F.sum(F.when(~buy, F.col("price"))).alias("sell_sum"), F.count_if(~buy).alias("sells"))
            .select("symbol", F.col("w.start").alias("open_time"), "buy_sum", "buys", "sell_sum", "sells"))


class Carry:
    """State between epochs: one folder per epoch, so replaying an epoch finds the state it started from."""

    def __init__(self, path: str):
        self.path = path

    def before(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.path}/epoch={epoch - 1}") if epoch > 0 else None

    def save(self, state: DataFrame, epoch: int) -> None:
        """Also drops the epoch that no replay can start from any more: a replayed epoch needs the one before it."""
        state.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        sc = state.sparkSession.sparkContext
        old = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={epoch - 2}")
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)


Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def carried(stream: DataFrame, step: Step, out: str, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs step(batch, state before) -> (rows, state after) on every micro-batch.

    Rows of an epoch replace its folder under out, so a retried epoch is not
    written twice. The batch is kept for the step's two outputs only.
    """
    carry = Carry(state)

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows, after = step(batch, carry.before(spark, epoch))
            rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
            carry.save(after, epoch)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def gap_step(keys: Sequence[str], order: Sequence[str], number: str, block: int) -> Step:
    """Sequence gaps over a live feed: state is each key's last row."""
    keys, order = list(keys), list(order)
    need = list(dict.fromkeys([*keys, *order, number]))

    def step(batch, before):
        rows = batch.select(*need).withColumn("__seed", F.lit(False))
        if before is not None:
            rows = rows.unionByName(before.withColumn("__seed", F.lit(True)))
        # Seeds sort before the batch, whatever their block.
        where = F.when(F.col("__seed"), F.lit(None)).otherwise(F.floor(F.col(order[0]) / F.lit(block)))
        found = Q.sequence_gaps(rows, keys, [~F.col("__seed"), *order], number, where)
        rank = F.struct(~F.col("__seed"), *[F.col(c) for c in order])
        after = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in need if c not in keys]), rank).alias("__r")).select(*keys, "__r.*").select(*need)
        return found.filter(~F.col("__seed")).select(*keys, *[c for c in need if c not in keys], "gap"), after

    return step


def late_step(keys: Sequence[str], at: str) -> Step:
    """Late rows are marked, not dropped: late says a row is before its key's latest stamp of the batches before."""
    keys = list(keys)

    def step(batch, before):
        rows = batch
        if before is None:
            marked = rows.withColumn("late", F.lit(False))
            high = rows.groupBy(*keys).agg(F.max(at).alias("__high"))
        else:
            marked = (rows.join(before, keys, "left").withColumn("late", F.coalesce(F.col(at) < F.col("__high"), F.lit(False))).drop("__high"))
            high = (rows.groupBy(*keys).agg(F.max(at).alias("__high")).unionByName(before).groupBy(*keys).agg(F.max("__high").alias("__high")))
        return marked, high

    return step


def position_step() -> Step:
    """Running position per slot and cash per account over fills: state is both so far, cash as a row of no instrument."""
    def step(batch, before):
        fills = batch.select("account", "instrument", "t", "seq", L.signed().alias("dq"), (-(L.signed() * F.col("price") + F.col("fee"))).alias("dc"))
        where = F.floor(micros(fills, "t") / F.lit(32 * L.DAY))
        rows = scan(fills, L.SLOT, ["t", "seq"], where, sums={"position": F.col("dq")})
        rows = scan(rows, ["account"], ["t", "seq"], where, sums={"cash": F.col("dc")})
        state = fills.groupBy(*L.SLOT).agg(F.sum("dq").alias("amount")).withColumn("what", F.lit("position")).unionByName(
            fills.groupBy("account").agg(F.sum("dc").alias("amount")).select("account", F.lit(None).cast("string").alias("instrument"), "amount", F.lit("cash").alias("what")))
        if before is not None:
            so_far = lambda what, *keys: before.filter(F.col("what") == what).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("amount").alias(f"__{what}"))
            same = lambda *keys: reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            plus = lambda c: F.col(c) + F.coalesce(f"__{c}", F.lit(0.0))
            rows = rows.join(so_far("position", *L.SLOT), same(*L.SLOT), "left").withColumn("position", plus("position")).drop(*[f"__{k}" for k in L.SLOT])
            rows = rows.join(so_far("cash", "account"), same("account"), "left").withColumn("cash", plus("cash")).drop("__account", "__position", "__cash")
            state = state.unionByName(before).groupBy(*L.SLOT, "what").agg(F.sum("amount").alias("amount"))
        return rows.drop("dq", "dc"), state

    return step


def thin_step(interval: int, keys: Sequence[str], at: str) -> Step:
    """Minimum-interval downsampling: state is each key's last kept stamp, and what it still covers goes first."""
    keys = list(keys)

    def step(batch, before):
        rows = batch
        if before is not None:
            t, last = micros(batch, at), micros(before, "__last")
            rows = (batch.withColumn("__t", t).join(before.select(*keys, last.alias("__l")), keys, "left")
                    .filter(F.col("__l").isNull() | (F.col("__t") - F.col("__l") >= interval)).drop("__t", "__l"))
        kept = L.thin(rows, interval, keys, at)
        after = kept.groupBy(*keys).agg(F.max(at).alias("__last"))
        if before is not None:
            after = after.unionByName(before).groupBy(*keys).agg(F.max("__last").alias("__last"))
        return kept, after

    return step
