"""Queries that run as Structured Streaming over the events and orders tables, to the end of what is there (T)."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import DAY, HOUR, micros
from ..operators.ordered import running
from ..session import settle, shared_dir
from ..streaming import flows as T, keyed as K
from . import views as V
from .bars_and_panel import OHLCV
from .events_and_ledger import EQUITY, SIGN, mark_events
from .registry import query


def events_stream(s, d):
    return T.folder(s, d, V.table(s, d, "events").schema, "events.parquet")


def trades_stream(s, d):
    e = events_stream(s, d).filter(F.col("event_type") != "error")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("value").alias("price"), F.lit(1.0).alias("qty"),
                    F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell").alias("side"))


def work(s):
    return f"{shared_dir(s)}/tidemark/stream-{uuid.uuid4().hex}"


def collected(s, stream, mode="append"):
    """Runs a stream over what is there into Parquet and reads it back."""
    at = work(s)
    (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log")
     .trigger(availableNow=True).start().awaitTermination())
    return s.read.parquet(f"{at}/out")


PARTS = 4


def carried(s, df, part, step):
    """df arriving in PARTS deliveries, each a micro-batch of one stream that starts from the state of the one before."""
    at = work(s)
    for k in range(PARTS):
        df.filter(part == k).write.mode("append").parquet(f"{at}/in")
        T.carried(T.folder(s, f"{at}/in", df.schema), step, f"{at}/out", f"{at}/state", f"{at}/log").awaitTermination()
    return s.read.parquet(f"{at}/out")


def kept(s, df, part, make, at, lateness):
    """df arriving in PARTS deliveries to make(stream), whose state stays with its keys in Spark's store."""
    where = work(s)
    for k in range(PARTS):
        df.filter(part == k).write.mode("append").parquet(f"{where}/in")
        stream = make(T.folder(s, f"{where}/in", df.schema).withWatermark(at, lateness))
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{where}/out")


def delivered(s, d):
    """Events with the delivery they come in: a quarter of January each, every 50th event a delivery late."""
    e = V.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    due = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(PARTS - 1))
    return e, due, F.least(due + (F.col("event_id") % 50 == 7).cast("bigint"), F.lit(PARTS - 1))


DUE = f"least((day(ts) - 1) // 8, {PARTS - 1})"


@query("t1_replay_order", "instrument t kind seq position", """
SELECT instrument, t, kind, seq, row_number() OVER (PARTITION BY instrument ORDER BY t, b, seq) AS position FROM (
  SELECT instrument, t, seq, 'trade' AS kind, 0 AS b FROM fills UNION ALL SELECT instrument, t, 0, 'mark_kline', 1 FROM marks)""")
def _(s, d):
    order = T.replay_order(F.col("kind"), "t", "seq")
    events = settle(mark_events(s, d))
    return running(events, ["instrument"], order, F.floor(micros(events, "t") / F.lit(32 * DAY)), sums={"position": F.lit(1).cast("bigint")})


@query("t2_merged_streams", "batch day n", f"""
WITH x AS (SELECT *, event_id % 2 = 0 AS fast, {DUE} AS part FROM events),
w AS (SELECT k AS batch, least((SELECT max(ts) FROM x WHERE fast), (SELECT max(ts) FROM x WHERE NOT fast AND part < k)) AS mark FROM range(1, {PARTS + 1}) r(k)),
days AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n FROM x GROUP BY 1)
SELECT * FROM (SELECT (SELECT min(batch) FROM w WHERE days.day + 1 <= w.mark) AS batch, day, n FROM days) WHERE batch IS NOT NULL""")
def _(s, d):
    # One feed is all there at once, the other comes a quarter a batch: a day is final in the batch after the one where the slower feed has passed it.
    e, due, _ = delivered(s, d)
    at, fast, files = work(s), F.col("event_id") % 2 == 0, 8
    e.filter(fast).repartition(files).write.parquet(f"{at}/fast")
    for k in range(PARTS):
        e.filter(~fast & (due == k)).repartition(files).write.mode("append").parquet(f"{at}/slow")
    both = [T.folder(s, f"{at}/{feed}", e.schema, files=files).select("ts") for feed in ("fast", "slow")]
    days = T.merged(both, "ts", "0 seconds").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))

    def keep(rows, batch):
        rows.select(F.lit(batch).cast("bigint").alias("batch"), F.col("w.start").cast("date").alias("day"), "n").write.mode("overwrite").parquet(f"{at}/out/epoch={batch}")

    days.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out").drop("epoch")


@query("t3_late_rows", "event_id late", f"""
WITH x AS (SELECT event_id, user_id, ts, least({DUE} + (event_id % 50 = 7)::INT, {PARTS - 1}) AS part FROM events)
SELECT event_id, ts < coalesce((SELECT max(y.ts) FROM x y WHERE y.user_id = x.user_id AND y.part < x.part), ts) AS late FROM x""")
def _(s, d):
    e, _, part = delivered(s, d)
    return carried(s, e, part, T.late_step(["user_id"], "ts"))


@query("t4_sequence_gaps", "stream gaps n", """
SELECT (user_id % 10)::VARCHAR AS stream, count(*) FILTER (event_id <> p + 1) AS gaps, count(*) AS n FROM (
  SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS p FROM events) GROUP BY 1""")
def _(s, d):
    e = V.table(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("stream"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    # Ids come in order, in PARTS ranges.
    top = e.agg(F.max("event_id")).first()[0] + 1
    out = kept(s, e, F.floor(F.col("event_id") * PARTS / F.lit(top)), lambda x: K.gaps(x, ["stream"], ["event_id"], "event_id", "ts", 7 * DAY // 1000), "ts", "0 seconds")
    return out.groupBy("stream").agg(F.count_if("gap").alias("gaps"), F.count(F.lit(1)).alias("n"))


@query("t5_stream_bars", "symbol open_time open~6 high~6 low~6 close~6 volume~2", f"""
SELECT symbol, open_time, open, high, low, close, volume FROM ({OHLCV}) WHERE t <= (SELECT max(ts) FROM trades)""")
def _(s, d):
    # A bar is written once the watermark passes its close, which the newest trades' bars have not seen.
    return collected(s, T.ohlcv(trades_stream(s, d), "1 hour", "0 seconds"))


@query("t5_side_buckets", "symbol open_time buy_sum~6 buys sell_sum~6 sells", """
SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS open_time, sum(price) FILTER (side = 'buy') AS buy_sum, count(*) FILTER (side = 'buy') AS buys,
  sum(price) FILTER (side = 'sell') AS sell_sum, count(*) FILTER (side = 'sell') AS sells FROM trades GROUP BY 1, 2
HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM trades)""")
def _(s, d):
    return collected(s, T.side_buckets(trades_stream(s, d), "15 minutes", "0 seconds"))


@query("t6_thinned_stream", "user_id ts", """
WITH RECURSIVE e AS (SELECT user_id, ts FROM events), k AS (
  SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT k.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 24 HOUR) FROM k
  WHERE (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 24 HOUR) IS NOT NULL)
SELECT user_id, ts FROM k""")
def _(s, d):
    e, due, _ = delivered(s, d)
    return kept(s, e.select("user_id", "ts"), due, lambda x: K.thinned(x, 24 * HOUR, ["user_id"], "ts"), "ts", "0 seconds")


@query("t7_running_positions", "account instrument seq position~4 cash~3", """
SELECT account, instrument, seq, sum(q) OVER w AS position, sum(-(q * price + fee)) OVER (PARTITION BY account ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cash FROM (
  SELECT o_orderpriority AS account, o_orderstatus AS instrument, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS q, o_totalprice / 1000 AS price, 0.1 AS fee FROM orders)
WINDOW w AS (PARTITION BY account, instrument ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""")
def _(s, d):
    o = V.table(s, d, "orders")
    f = o.select(F.col("o_orderpriority").alias("account"), F.col("o_orderstatus").alias("instrument"), F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderkey").alias("seq"),
                 F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(1.0).alias("qty"), (F.col("o_totalprice") / 1000).alias("price"), F.lit(0.1).alias("fee"))
    # A few accounts hold all rows, so they are cut into blocks of time; K.positions would take each through one task.
    return carried(s, f, by_year(F.col("t")), T.position_step()).drop("t")


def by_year(t):
    return F.least(F.greatest(F.year(t) - 1995, F.lit(0)), F.lit(PARTS - 1))


@query("t7_stream_equity", "account t cash~2 value~2 equity~2", """
SELECT account, t, cash, value, cash + value AS equity FROM eq
WHERE t <= (SELECT max(t) FROM (SELECT t FROM fills UNION ALL SELECT t FROM marks UNION ALL SELECT t FROM nfunding)) - 40""", ctes=EQUITY)
def _(s, d):
    # Half of the marks of a year's last weeks come with the next year's events.
    events = reduce(DataFrame.unionByName, K.book_events(V.fills(s, d), V.marks(s, d), V.nation_funding(s, d)))
    late = (F.col("kind") == "mark") & (F.dayofyear("t") > 340) & (F.crc32("instrument") % 2 == 0)
    events = settle(events.withColumn("part", F.least(by_year(F.col("t")) + late.cast("int"), F.lit(PARTS - 1))))
    return kept(s, events, F.col("part"), lambda x: K.equity(K.netted(x.drop("part"))), "t", "40 days").withColumn("t", F.col("t").cast("date"))


@query("t8_kind_filter", "event_id kind", "SELECT event_id, event_type AS kind FROM events WHERE event_type IN ('click', 'purchase')")
def _(s, d):
    return collected(s, T.of_kinds(events_stream(s, d).select("event_id", F.col("event_type").alias("kind")), ["click", "purchase"]))


@query("t9_bars_at_close", "symbol t n", f"SELECT symbol, t, count(*) AS n FROM ({OHLCV}) WHERE t <= (SELECT max(ts) FROM trades) GROUP BY 1, 2")
def _(s, d):
    return collected(s, T.ohlcv(trades_stream(s, d), "1 hour", "0 seconds")).groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("n"))
