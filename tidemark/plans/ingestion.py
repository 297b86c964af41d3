"""Queries for sources and data quality (S, Q). Archive text is derived from the tables by Spark, then read back as an archive is."""
from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions.columns import DAY
from ..operators import bars as B, grid as G, panel as P, quality as Q
from ..session import settle, shared_dir
from ..sources import archive as A, cost_table as CT, lake as K, payloads as PL
from . import views as V
from .bars_and_panel import long_bars, panel, stored_long, stored_panel
from .oracle_views import FLOOR
from .registry import query


def millis(day):
    return (F.unix_date(day).cast("bigint") * 86_400_000)


def kline_lines(s, d):
    """Daily bars as kline files, one per brand and month: microsecond stamps from 1999, an empty volume now and then, a header where the month is odd."""
    b = V.bars(s, d)
    ms = millis("at")
    unit = F.when(F.year("at") >= 1999, 1000).otherwise(1)
    volume = F.when(F.dayofmonth("at") == 13, F.lit("")).otherwise(F.col("volume").cast("string"))
    line = F.concat_ws(",", (ms * unit).cast("string"), *[F.col(c).cast("string") for c in ("close", "high", "low", "close")], volume,
                       ((ms + 86_399_999) * unit).cast("string"), (F.col("volume") * 2).cast("string"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0"))
    file = F.concat(F.lit("klines/"), "symbol", F.lit("-1d-"), F.date_format("at", "yyyy-MM"), F.lit(".csv"))
    rows = b.select("symbol", file.alias("file"), F.unix_date("at").cast("bigint").alias("pos"), line.alias("line"))
    heads = (b.filter(F.month("at") % 2 == 1).select("symbol", file.alias("file")).distinct()
             .select("symbol", "file", F.lit(-1).cast("bigint").alias("pos"), F.lit("open_time,open,high,low,close,volume").alias("line")))
    return rows.unionByName(heads).withColumn("stream", F.col("symbol"))


KLINES = """SELECT symbol, epoch_ns(at::TIMESTAMP) AS open_time_ns, epoch_ns(at::TIMESTAMP) + 86399999000000 AS ts_ns, close AS open, high, low, close, {v} AS volume FROM bd WHERE day(at) <> 13"""


@query("s1_klines", "symbol open_time_ns ts_ns open~6 high~6 low~6 close~6 volume~4", KLINES.format(v="volume"))
def _(s, d):
    return A.read_klines(kline_lines(s, d), "usdm").filter(F.col("status") == "parsed")


@query("s1_klines_coinm", "symbol open_time_ns ts_ns volume~4", KLINES.format(v="volume * 2"))
def _(s, d):
    return A.read_klines(kline_lines(s, d), "coinm").filter(F.col("status") == "parsed")


@query("s2_mark_klines", "symbol open_time_ns ts_ns open~6 high~6 low~6 close~6", KLINES.format(v="volume"))
def _(s, d):
    return A.read_mark_klines(kline_lines(s, d)).filter(F.col("status") == "parsed")


@query("s3_premium_klines", "symbol ts_ns close~10", """
SELECT symbol, epoch_ns(t::TIMESTAMP) + 86399999000000 AS ts_ns, funding_rate AS close FROM prints""")
def _(s, d):
    p = V.prints(s, d)
    r, ms = F.col("funding_rate").cast("string"), millis("t")
    line = F.concat_ws(",", ms.cast("string"), r, r, r, r, F.lit("0"), (ms + 86_399_999).cast("string"))
    raw = p.select("symbol", F.col("symbol").alias("stream"), F.lit("premium.csv").alias("file"), F.unix_date("t").alias("pos"), line.alias("line"))
    return A.read_premium_klines(raw).filter(F.col("status") == "parsed")


def funding_lines(s, d):
    """Prints as funding rows; the interval is 8, 4 or an invalid 0 by day."""
    p = V.prints(s, d)
    hours = F.element_at(F.array(F.lit("8"), F.lit("4"), F.lit("0")), (F.pmod(F.unix_date("t"), F.lit(3)) + 1).cast("int"))
    line = F.concat_ws(",", millis("t").cast("string"), hours, F.col("funding_rate").cast("string"))
    return p.select("symbol", F.col("symbol").alias("stream"), F.lit("funding.csv").alias("file"), F.unix_date("t").alias("pos"), line.alias("line"))


@query("s4_funding", "symbol ts_ns interval_hours funding_rate~10", """
SELECT symbol, epoch_ns(t::TIMESTAMP) AS ts_ns, CASE WHEN (t - DATE '1970-01-01') % 3 = 0 THEN 8 ELSE 4 END::BIGINT AS interval_hours, funding_rate FROM prints WHERE (t - DATE '1970-01-01') % 3 <> 2""")
def _(s, d):
    return A.read_funding(funding_lines(s, d)).filter(F.col("status") == "parsed")


@query("s5_metrics", "symbol ts_ns open_interest~4 open_interest_value~3 toptrader_account_ratio~6", """
SELECT symbol, epoch_ns(at::TIMESTAMP) AS ts_ns, volume AS open_interest, close * volume AS open_interest_value, CASE WHEN day(at) > 3 THEN high / low END AS toptrader_account_ratio
FROM bd WHERE day(at) <> 28""")
def _(s, d):
    b = V.bars(s, d)
    ratio = F.when(F.dayofmonth("at") > 3, (F.col("high") / F.col("low")).cast("string")).otherwise(F.lit(""))
    # The 28th writes a longer stamp, which is another format and rejected.
    stamp = F.when(F.dayofmonth("at") == 28, F.date_format("at", "yyyy-MM-dd'T00:00:00Z'")).otherwise(F.date_format("at", "yyyy-MM-dd' 00:00:00'"))
    line = F.concat_ws(",", stamp, "symbol", F.col("volume").cast("string"), (F.col("close") * F.col("volume")).cast("string"), ratio, F.lit(""), F.lit("1.5"), F.lit("2"))
    raw = b.select("symbol", F.col("symbol").alias("stream"), F.lit("metrics.csv").alias("file"), F.unix_date("at").alias("pos"), line.alias("line"))
    return A.read_metrics(raw).filter(F.col("status") == "parsed")


def trade_lines(s, d):
    """Every event as an aggregated trade of its user's stream, one file a day: ids are event ids, an error event's price is 0."""
    e = V.table(s, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    price = F.when(F.col("event_type") == "error", F.lit("0")).otherwise(F.col("value").cast("string"))
    maker = F.when(F.col("event_type").isin("click", "purchase"), "False").otherwise("true")
    line = F.concat_ws(",", F.col("event_id").cast("string"), price, F.lit("1"), F.col("event_id").cast("string"), F.col("event_id").cast("string"), us.cast("string"), maker)
    return e.select((F.col("user_id") % 10).cast("string").alias("symbol"), (F.col("user_id") % 10).cast("string").alias("stream"),
                    F.date_format("ts", "'trades-'yyyy-MM-dd'.csv'").alias("file"), F.col("event_id").alias("pos"), line.alias("line"))


@query("s6_agg_trades", "symbol id ts_ns price~6 qty~2 side", """
SELECT (user_id % 10)::VARCHAR AS symbol, event_id AS id, epoch_ns(ts) AS ts_ns, value AS price, 1.0 AS qty, CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS side
FROM events WHERE event_type <> 'error' AND value > 0""")
def _(s, d):
    return A.read_agg_trades(trade_lines(s, d)).filter(F.col("status") == "parsed")


def depth_lines(s, d):
    """Each order's total as a ten-band depth sample; orders whose key ends in 7 lose a band, in 3 gain the inner pair."""
    o = V.table(s, d, "orders")
    pct = F.array(*[F.lit(float(k)) for k in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)])
    last = F.col("o_orderkey") % 10
    bands = F.when(last == 7, F.slice(pct, 1, 9)).when(last == 3, F.concat(pct, F.array(F.lit(-0.2), F.lit(0.2)))).otherwise(pct)
    e = o.select("o_orderkey", "o_totalprice", F.posexplode(bands).alias("n", "p"))
    stamp = F.date_format(F.timestamp_seconds(F.col("o_orderkey") * 60), "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(",", stamp, F.col("p").cast("string"), (F.abs("p") * 10).cast("string"), (F.abs("p") * F.col("o_totalprice")).cast("string"))
    return e.select(F.lit("BTC").alias("stream"), F.concat(F.lit("bookDepth-"), (F.floor(F.col("o_orderkey") / 500)).cast("string")).alias("file"),
                    (F.col("o_orderkey") * 100 + F.col("n")).alias("pos"), line.alias("line"))


@query("s7_book_depth", "ts_ns rows first_bid~2 last_ask~2", """
SELECT o_orderkey * 60000000000 AS ts_ns, CASE WHEN o_orderkey % 10 = 3 THEN 12 ELSE 10 END::BIGINT AS rows, o_totalprice AS first_bid, 5 * o_totalprice AS last_ask FROM orders WHERE o_orderkey % 10 <> 7""")
def _(s, d):
    r = A.read_book_depth(depth_lines(s, d)).filter(F.col("status") == "parsed")
    return r.withColumn("first_bid", F.element_at("bids", 1)["notional"]).withColumn("last_ask", F.element_at("asks", 5)["notional"])


@query("s8_epoch_stamps", "symbol at ns", "SELECT symbol, at, epoch_ns(at::TIMESTAMP) AS ns FROM bd")
def _(s, d):
    from ..sources import fields as X
    return V.bars(s, d).withColumn("text", (millis("at") * F.when(F.year("at") >= 1999, 1000).otherwise(1)).cast("string")).withColumn("ns", X.epoch_ns(F.col("text")))


@query("s9_datetime_stamps", "event_id ns", """
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE epoch_ns(date_trunc('second', ts)) END AS ns FROM events""")
def _(s, d):
    from ..sources import fields as X
    e = V.table(s, d, "events")
    text = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.withColumn("text", text).withColumn("ns", X.datetime_ns(F.col("text")))


@query("s10_row_status", "symbol status n", """
SELECT symbol, CASE WHEN day(at) = 13 THEN 'rejected' ELSE 'parsed' END AS status, count(*) AS n FROM bd GROUP BY 1, 2
UNION ALL SELECT symbol, 'header', count(DISTINCT date_trunc('month', at)) FROM bd WHERE month(at) % 2 = 1 GROUP BY 1""")
def _(s, d):
    return A.read_klines(kline_lines(s, d), "usdm").groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


@query("s11_field_coercions", "event_id i d~6 b", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS i, CASE WHEN event_id % 4 <> 1 THEN value END AS d, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS b FROM events""")
def _(s, d):
    from ..sources import fields as X
    e = V.table(s, d, "events")
    i = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("x")))
    v = F.when(F.col("event_id") % 4 == 1, F.lit("1,2")).otherwise(F.col("value").cast("string"))
    b = F.when(F.col("event_type") == "click", "True").when(F.col("event_type") == "view", "false").otherwise("TRUE")
    return e.select("event_id", X.integer(i).alias("i"), X.decimal(v).alias("d"), X.boolean(b).alias("b"))


BROKEN = ("Brand#11-1d-1996-01.zip", "Brand#25-1d-2000-01.zip")


def zip_archive(s, d, broken=()):
    """The kline lines as one zip per brand and year in the shared folder, written by the tasks that hold them; broken names hold something else."""
    root = f"{shared_dir(s)}/tidemark/zips-{uuid.uuid4().hex}"
    raw = kline_lines(s, d).withColumn("name", F.concat("symbol", F.lit("-1d-"), F.substring(F.regexp_extract("file", r"([0-9]{4}-[0-9]{2})", 1), 1, 4), F.lit("-01.zip")))
    ordered = raw.repartition("name").sortWithinPartitions("name", "file", "pos").select("name", "line")

    def pack(batches):
        import io
        import itertools
        import zipfile

        import pandas as pd
        from pyarrow import fs
        files, base = (fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:")))
        files.create_dir(base)
        rows = ((n, l) for b in batches for n, l in zip(b["name"], b["line"]))
        for name, group in itertools.groupby(rows, key=lambda r: r[0]):
            # Rewriting a file on a retried task gives the same file.
            with files.open_output_stream(f"{base}/{name}") as out:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z, z.open(name.replace(".zip", ".csv"), "w") as f:
                    for _, line in group:
                        f.write(line.encode() + b"\r\n")
                out.write(b"no archive" if name in broken else buffer.getvalue())
            yield pd.DataFrame({"name": [name]})

    ordered.mapInPandas(pack, "name string").write.format("noop").mode("overwrite").save()
    return root


@query("s12_zipped_klines", "symbol open_time_ns ts_ns close~6 volume~4",
       "SELECT symbol, epoch_ns(at::TIMESTAMP) AS open_time_ns, epoch_ns(at::TIMESTAMP) + 86399999000000 AS ts_ns, close, volume FROM bd WHERE day(at) <> 13")
def _(s, d):
    raw = A.with_stream(A.zipped_lines(s, zip_archive(s, d)))
    return A.read_klines(raw, "usdm").filter(F.col("status") == "parsed")


@query("s13_zip_span", "symbol open_time_ns close~6 failed", """
SELECT symbol, epoch_ns(at::TIMESTAMP) AS open_time_ns, close, false AS failed FROM bd WHERE day(at) <> 13 AND year(at) BETWEEN 1997 AND 1999""")
def _(s, d):
    # The broken files are outside the span: had they been opened, there were failed rows.
    raw = A.with_stream(A.zipped_lines(s, zip_archive(s, d, BROKEN), "1997-01", "1999-12"))
    rows = A.read_klines(raw, "usdm").filter(F.col("status").isin("parsed", "failed"))
    return rows.withColumn("failed", F.col("status") == "failed")


@query("s13_zip_filter", "symbol open_time_ns close~6 failed", """
SELECT symbol, epoch_ns(at::TIMESTAMP) AS open_time_ns, close, false AS failed FROM bd WHERE day(at) <> 13 AND year(at) BETWEEN 1997 AND 1999 AND symbol IN ('Brand#11', 'Brand#25', 'Brand#33')""")
def _(s, d):
    # Filters as a user writes them, after the reader; names outside them are broken files, which would give failed rows.
    raw = A.with_stream(A.zipped_lines(s, zip_archive(s, d, BROKEN)))
    rows = A.read_klines(raw, "usdm").filter(F.col("status").isin("parsed", "failed")).withColumn("failed", F.col("status") == "failed")
    return rows.filter(F.col("symbol").isin("Brand#11", "Brand#25", "Brand#33") & (F.col("start") >= "1997-01-01") & (F.col("stamp") >= "1997") & (F.col("stamp") < "2000"))


@query("s13_text_span", "symbol open_time_ns close~6", """
SELECT symbol, epoch_ns(at::TIMESTAMP) AS open_time_ns, close FROM bd WHERE day(at) <> 13 AND at >= DATE '1997-03-01' AND at < DATE '1997-06-01'""")
def _(s, d):
    # A month's lines of all brands are one folder of text; Spark names files itself, so the folder's name carries the stamp as a file's would.
    root = f"{shared_dir(s)}/tidemark/text-{uuid.uuid4().hex}"
    month = F.regexp_extract("file", r"([0-9]{4}-[0-9]{2})\.csv$", 1)
    lines = kline_lines(s, d).filter(F.col("pos") >= 0).select(F.concat_ws(",", "line", "symbol").alias("value"), F.concat(F.lit("all-1d-"), month, F.lit(".csv")).alias("month"))
    lines.repartition("month").write.partitionBy("month").text(root)
    names = s.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("file")).distinct()
    wanted = [r.file for r in A.files_between(names, "1997-03-01", "1997-05-01").collect()]
    t = s.read.option("recursiveFileLookup", True).text(wanted).select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("pos"), F.col("value").alias("line"))
    t = t.withColumn("symbol", F.substring_index("line", ",", -1)).withColumn("stream", F.col("symbol"))
    return A.read_klines(t, "usdm").filter(F.col("status") == "parsed")


@query("s13_file_pruning", "file", """
SELECT DISTINCT 'klines/' || symbol || '-1d-' || strftime(at, '%Y-%m') || '.csv' AS file FROM bd WHERE at >= DATE '1997-03-01' AND at < DATE '1997-06-01'""")
def _(s, d):
    return A.files_between(kline_lines(s, d).select("file").distinct(), "1997-03-01", "1997-05-01")


def lake_copy(s, d):
    """The daily bars written to a lake in the shared folder."""
    path = f"{shared_dir(s)}/tidemark/lake-{uuid.uuid4().hex}"
    b = V.bars(s, d).withColumn("open_time", F.col("at").cast("timestamp")).withColumn("dataset", F.lit("klines_1d")).drop("at")
    K.write(b, path, at="open_time")
    return path


@query("s14_span_scan", "symbol open_time close~6", """
SELECT symbol, at::TIMESTAMP AS open_time, close FROM bd WHERE at >= DATE '1997-03-10' AND at < DATE '1998-05-05' AND symbol IN ('Brand#11', 'Brand#23')""")
def _(s, d):
    return K.scan(s, lake_copy(s, d), "klines_1d", "1997-03-10", "1998-05-05", ["Brand#11", "Brand#23"], at="open_time")


@query("s15_lake_partitions", "year month rows", "SELECT year(at) AS year, month(at) AS month, count(*) AS rows FROM bd GROUP BY 1, 2")
def _(s, d):
    return K.read(s, lake_copy(s, d)).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


@query("s15_lake_appends", "symbol at close~6", "SELECT symbol, at, CASE WHEN day(at) = 9 THEN 2 * close ELSE close END AS close FROM bd")
def _(s, d):
    # Odd and even brands, then the 9th of each month again, in separate writes of the same months.
    path = f"{shared_dir(s)}/tidemark/lake-{uuid.uuid4().hex}"
    b = V.stored_bars(s, d).select("symbol", "close", F.col("at").cast("timestamp").alias("open_time"), F.lit("klines_1d").alias("dataset"))
    odd, ninth = F.substring("symbol", -1, 1).cast("int") % 2 == 1, F.dayofmonth("open_time") == 9
    for part in (b.filter(odd & ~ninth), b.filter(~odd), b.filter(ninth).withColumn("close", F.col("close") * 2)):
        K.write(part, path, at="open_time")
    return K.klines(s, path, "1990-01-01", "2010-01-01").select("symbol", F.to_date("open_time").alias("at"), "close")


@query("s15_compacted_lake", "symbol at close~6 months", """
SELECT symbol, at, CASE WHEN day(at) = 9 THEN 2 * close ELSE close END AS close, (SELECT count(DISTINCT date_trunc('month', at)) FROM bd) AS months FROM bd""")
def _(s, d):
    # Three commits hold every month; compaction makes one of it, and vacuum deletes what that replaced.
    path = f"{shared_dir(s)}/tidemark/lake-{uuid.uuid4().hex}"
    b = V.stored_bars(s, d).select("symbol", "close", F.col("at").cast("timestamp").alias("open_time"), F.lit("klines_1d").alias("dataset"))
    ninth = F.dayofmonth("open_time") == 9
    for part in (b, b.filter(ninth).withColumn("close", F.col("close") * 3), b.filter(ninth).withColumn("close", F.col("close") * 2)):
        K.write(part, path, at="open_time")
    months = K.compact(s, path, least=1)
    K.vacuum(s, path)
    return K.klines(s, path, "1990-01-01", "2010-01-01").select("symbol", F.to_date("open_time").alias("at"), "close", F.lit(months).cast("bigint").alias("months"))


@query("q11_lake_holdings", "symbol days rows", "SELECT symbol, count(DISTINCT at) AS days, count(*) AS rows FROM bd GROUP BY 1")
def _(s, d):
    held = K.holdings(s, lake_copy(s, d))
    return held.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"))


@query("s16_daily_bars", "symbol at high~6 low~6 close~6 volume~4", "SELECT symbol, at, high, low, close, volume FROM bd")
def _(s, d):
    return K.daily_bars(K.klines(s, lake_copy(s, d), "1990-01-01", "2010-01-01"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("s16_open_interest", "t " + " ".join(f"b{b[6:]}~3" for b in BRANDS),
       "SELECT at AS t, " + ", ".join(f"max(CASE WHEN symbol = '{b}' THEN close * volume END) AS b{b[6:]}" for b in BRANDS) + " FROM bd GROUP BY 1")
def _(s, d):
    m = V.bars(s, d).select("symbol", F.col("at").alias("t"), (F.col("close") * F.col("volume")).alias("open_interest_value"), F.lit(0).alias("seq"))
    return K.open_interest(m, BRANDS).select("t", *[F.col(b).alias(f"b{b[6:]}") for b in BRANDS])


@query("s17_json_bars", "symbol at close~6 volume~4", "SELECT symbol, at, close, volume FROM bd WHERE day(at) <> 1")
def _(s, d):
    # One payload per symbol and month, as a fetch returns, with the close of each first missing.
    b = V.bars(s, d).withColumn("close", F.when(F.dayofmonth("at") != 1, F.col("close")))
    packed = b.groupBy("symbol", F.trunc("at", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct("at", "close", "volume"))).alias("r"))
    payload = F.to_json(F.struct(F.transform("r", lambda x: F.unix_date(x["at"]).cast("bigint") * 86400).alias("timestamp"),
                                 F.transform("r", lambda x: x["close"]).alias("adjclose"), F.transform("r", lambda x: x["volume"]).alias("volume")),
                        {"ignoreNullFields": "false"})
    return PL.array_bars(packed.select("symbol", payload.alias("payload")))


@query("s18_cost_csv", "symbol market week_start half_spread_bps~6 impact_bps_per_unit~6 taker_fee_bps~2", """
SELECT symbol, 1::BIGINT AS market, week_start, half_spread_bps, CASE WHEN month(week_start) = 2 THEN 0 ELSE impact_bps_per_unit END AS impact_bps_per_unit, taker_fee_bps
FROM cost_rows WHERE symbol NOT LIKE '%5'""")
def _(s, d):
    path = f"{shared_dir(s)}/tidemark/costs-{uuid.uuid4().hex}"
    c = V.cost_rows(s, d).select("taker_fee_bps", "symbol", F.lit("1").alias("market"), F.when(F.month("week_start") != 2, F.col("impact_bps_per_unit")).alias("impact_bps_per_unit"),
                                 "week_start", "half_spread_bps")
    c.write.csv(path, header=True)
    known = V.table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.lit(1).alias("market")).filter(~F.endswith("symbol", F.lit("5")))
    return CT.typed(CT.read_csv(s, path), known)


@query("s20_instrument_tags", "symbol", """
SELECT DISTINCT p_brand || p_type AS symbol FROM part WHERE p_type LIKE '%A%' OR p_size % 7 = 0""")
def _(s, d):
    p = V.table(s, d, "part")
    one = F.struct(F.concat("p_brand", "p_type").alias("symbol"), F.when(F.contains("p_type", F.lit("A")), "TRADIFI_PERPETUAL").otherwise("PERPETUAL").alias("contractType"),
                   F.when(F.col("p_size") % 7 == 0, F.array(F.lit("DEX"), F.lit("RWA"))).otherwise(F.array(F.lit("DEX"))).alias("underlyingSubType"))
    return PL.non_crypto(p.select(F.to_json(F.struct(F.array(one).alias("symbols"))).alias("payload")))


# Quality ----------------------------------------------------------------------------------------------------

@query("q1_quality_report", "stream files header_rows blank_rows parsed_rows rejected_rows backwards_stamps repeated_stamps sequence_gaps", """
WITH p AS (SELECT (user_id % 10)::VARCHAR AS stream, event_id AS id, ts, CAST(ts AS DATE) AS f, event_type <> 'error' AND value > 0 AS ok FROM events),
o AS (SELECT stream, id, ts, lag(id) OVER w AS pi, lag(ts) OVER w AS pt FROM p WHERE ok WINDOW w AS (PARTITION BY stream ORDER BY f, id))
SELECT c.stream, files, 0 AS header_rows, 0 AS blank_rows, parsed AS parsed_rows, n - parsed AS rejected_rows, back AS backwards_stamps, rep AS repeated_stamps, gaps AS sequence_gaps FROM (
  SELECT stream, count(*) AS n, count(*) FILTER (ok) AS parsed, count(DISTINCT f) AS files FROM p GROUP BY 1) c JOIN (
  SELECT stream, count(*) FILTER (ts < pt) AS back, count(*) FILTER (ts = pt) AS rep, count(*) FILTER (id <> pi + 1) AS gaps FROM o GROUP BY 1) g ON g.stream = c.stream""")
def _(s, d):
    return A.quality_report(A.read_agg_trades(trade_lines(s, d)), sequence="id")


@query("q1_archive_report", "stream planned_files files failed_files missing_files expected_rows header_rows parsed_rows rejected_rows", f"""
WITH f AS (SELECT symbol, year(at) AS y, count(*) FILTER (day(at) <> 13) AS good, count(*) FILTER (day(at) = 13) AS bad,
  count(DISTINCT CASE WHEN month(at) % 2 = 1 THEN month(at) END) AS heads, symbol || '-1d-' || year(at) || '-01.zip' AS name FROM bd GROUP BY 1, 2),
b AS (SELECT *, name IN {BROKEN} AS broken FROM f)
SELECT symbol AS stream, count(*) + 1 AS planned_files, count(*) AS files, count(*) FILTER (broken) AS failed_files, 1::BIGINT AS missing_files, 31 * (count(*) + 1) AS expected_rows,
  coalesce(sum(heads) FILTER (NOT broken), 0)::BIGINT AS header_rows, coalesce(sum(good) FILTER (NOT broken), 0)::BIGINT AS parsed_rows,
  coalesce(sum(bad) FILTER (NOT broken), 0)::BIGINT AS rejected_rows
FROM b GROUP BY 1""")
def _(s, d):
    # Every brand's yearly zips are planned and one of 2030 that never came; two files are no zips.
    raw = A.with_stream(A.zipped_lines(s, zip_archive(s, d, BROKEN)))
    b = V.stored_bars(s, d)
    years = b.select("symbol", F.year("at").alias("y")).union(b.select("symbol", F.lit(2030))).distinct()
    planned = A.with_stream(years.select(F.concat("symbol", F.lit("-1d-"), F.col("y").cast("string"), F.lit("-01.zip")).alias("file")))
    planned = Q.expected_rows(planned.withColumn("width_seconds", A.interval_seconds(F.lit("1d"))))
    return A.quality_report(A.read_klines(raw, "usdm"), planned=planned.select("stream", "file", "expected"))


@query("q2_expected_rows", "file span expected", """
SELECT DISTINCT 'klines/' || symbol || '-1d-' || strftime(at, '%Y-%m') || '.csv' AS file, 'month' AS span, day(last_day(at)) AS expected FROM bd""")
def _(s, d):
    f = A.with_stream(kline_lines(s, d).select("file").distinct()).withColumn("width_seconds", A.interval_seconds(F.lit("1d")))
    return Q.expected_rows(f)


@query("q3_stamp_order", "stream event_id backwards repeated", """
SELECT user_id::VARCHAR AS stream, event_id, coalesce(ts < lag(ts) OVER w, false) AS backwards, coalesce(ts = lag(ts) OVER w, false) AS repeated FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").cast("string").alias("stream"), "event_id", "ts")
    return Q.stamp_order(e, ["stream"], ["event_id"], "ts", F.floor(F.col("event_id") / 4096))


@query("q4_sequence_gaps", "stream gaps n", """
SELECT stream, count(*) FILTER (event_id <> p + 1) AS gaps, count(*) AS n FROM (
  SELECT (user_id % 10)::VARCHAR AS stream, event_id, lag(event_id) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS p FROM events) GROUP BY 1""")
def _(s, d):
    e = V.table(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("stream"), "event_id")
    g = Q.sequence_gaps(e, ["stream"], ["event_id"], "event_id", F.floor(F.col("event_id") / 4096))
    return g.groupBy("stream").agg(F.count_if("gap").alias("gaps"), F.count(F.lit(1)).alias("n"))


@query("q5_fetch_plan", "id kind lo hi through", """
WITH r AS (SELECT o_orderkey AS id, ['daily', 'monthly', 'both'][(o_orderkey % 3 + 1)::INTEGER] AS cadence, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 120 AS e, CAST(o_orderdate AS DATE) + 90 AS n FROM orders),
m AS (SELECT *, CASE WHEN cadence = 'daily' THEN s ELSE greatest(s, least(e, date_trunc('month', n - 8)::DATE)) END AS mh FROM r),
d AS (SELECT *, CASE WHEN cadence = 'monthly' THEN mh ELSE greatest(mh, least(e, n - 1)) END AS dh FROM m)
SELECT id, 'Monthly' AS kind, s AS lo, mh AS hi, dh AS through FROM d WHERE s < mh UNION ALL SELECT id, 'Daily', mh, dh, dh FROM d WHERE mh < dh
UNION ALL SELECT id, NULL, NULL, NULL, dh FROM d WHERE s >= mh AND mh >= dh""")
def _(s, d):
    o = V.table(s, d, "orders")
    day = F.col("o_orderdate").cast("date")
    cadence = F.element_at(F.array(F.lit("daily"), F.lit("monthly"), F.lit("both")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return Q.fetch_plan(o.select(F.col("o_orderkey").alias("id"), cadence.alias("cadence"), day.alias("start"), F.date_add(day, 120).alias("end"), F.date_add(day, 90).alias("now")))


MISSING = """SELECT k.symbol, k.day FROM (SELECT symbol, CAST(unnest(generate_series(min(at)::TIMESTAMP, max(at)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM bd GROUP BY 1) k
ANTI JOIN bd ON bd.symbol = k.symbol AND bd.at = k.day"""


@query("q6_missing_days", "symbol day", MISSING)
def _(s, d):
    return Q.missing_days(V.stored_bars(s, d).withColumnRenamed("at", "day"))


@query("q7_contiguous_runs", "symbol first last days", f"""
SELECT symbol, min(day) AS first, max(day) AS last, count(*) AS days FROM (
  SELECT symbol, day, day - row_number() OVER (PARTITION BY symbol ORDER BY day)::INTEGER AS k FROM ({MISSING})) GROUP BY symbol, k""")
def _(s, d):
    return Q.missing_runs(V.stored_bars(s, d).withColumnRenamed("at", "day"))


@query("q8_backfill", "symbol open_time close~6", """
SELECT symbol, at AS open_time, CASE WHEN day(at) > 3 THEN close ELSE -close END AS close FROM bd""")
def _(s, d):
    b = V.stored_bars(s, d).select("symbol", F.col("at").alias("open_time"), "close")
    return Q.backfill(b.filter(F.dayofmonth("open_time") > 3), b.withColumn("close", -F.col("close")))


def manifest(s, d):
    """Partitions by brand and quarter with what each is complete through."""
    b = V.bars(s, d)
    return b.groupBy("symbol", F.trunc("at", "quarter").alias("part")).agg(F.max("at").alias("through"), F.count(F.lit(1)).alias("rows"), (F.sum("volume") * 8).alias("bytes"))


@query("q9_stale_partitions", "parts symbols first_symbol last_symbol", """
WITH m AS (SELECT symbol, date_trunc('quarter', at)::DATE AS part, max(at) AS through FROM bd GROUP BY 1, 2),
w AS (SELECT s.symbol, CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2002-01-01', INTERVAL 3 MONTH)) AS DATE) AS part FROM (SELECT DISTINCT symbol FROM bd) s),
st AS (SELECT w.symbol, w.part FROM w LEFT JOIN m ON m.symbol = w.symbol AND m.part = w.part WHERE through IS NULL OR through + 7 < least((w.part + INTERVAL 3 MONTH)::DATE, DATE '2001-10-20')),
l AS (SELECT symbol, string_agg(part::VARCHAR, ',' ORDER BY part) AS parts FROM st GROUP BY 1)
SELECT parts, count(*) AS symbols, min(symbol) AS first_symbol, max(symbol) AS last_symbol FROM l GROUP BY 1""")
def _(s, d):
    m = manifest(s, d).select("symbol", F.col("part").cast("string").alias("part"), F.date_add("through", 7).alias("through"))
    quarters = F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2002-01-01").cast("date"), F.expr("interval 3 months"))
    w = V.table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("q", F.explode(quarters))
    w = w.select("symbol", F.col("q").cast("string").alias("part"), F.add_months("q", 3).alias("part_end"))
    listed = m.select("symbol").distinct()
    return Q.stale_partitions(w.join(listed, "symbol", "left_semi"), m, F.lit("2001-10-20").cast("date"))


@query("q10_period_partitions", "symbol part_start part_end label", """
SELECT symbol, p::DATE AS part_start, (p + INTERVAL 1 MONTH)::DATE AS part_end, strftime(p, 'year=%Y/month=%m') AS label FROM (
  SELECT symbol, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b - 1)::TIMESTAMP, INTERVAL 1 MONTH)) AS p FROM (SELECT symbol, min(at) AS a, max(at) AS b FROM bd GROUP BY 1))""")
def _(s, d):
    return Q.period_partitions(V.bars(s, d).groupBy("symbol").agg(F.min("at").alias("start"), F.max("at").alias("end")))


@query("q11_inventory", "dataset partitions rows gb~9 last_read", """
SELECT symbol AS dataset, count(*) AS partitions, sum(n)::BIGINT AS rows, sum(b) / 1e9 AS gb, max(t) AS last_read FROM (
  SELECT symbol, date_trunc('quarter', at) AS q, count(*) AS n, sum(volume) * 8 AS b, max(at) AS t FROM bd GROUP BY 1, 2) GROUP BY 1""")
def _(s, d):
    return Q.inventory(manifest(s, d).withColumnRenamed("symbol", "dataset").withColumnRenamed("through", "last_read"))


@query("q12_unique_bars", "symbol at close~6", "SELECT symbol, at, close FROM bd")
def _(s, d):
    return Q.unique_bars(V.bars(s, d))


@query("q12_duplicate_keys", "l_orderkey l_linenumber n", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return Q.duplicate_keys(V.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q13_reconcile", "left_only right_only shared max_gap~6", """
SELECT count(*) FILTER (b.at IS NULL) AS left_only, count(*) FILTER (a.at IS NULL) AS right_only, count(*) FILTER (a.at IS NOT NULL AND b.at IS NOT NULL) AS shared,
  max(abs(a.close / b.close - 1)) AS max_gap FROM (SELECT * FROM bd WHERE volume > 0) a FULL JOIN (SELECT symbol, at, high AS close FROM bd WHERE day(at) <> 5) b ON a.symbol = b.symbol AND a.at = b.at""")
def _(s, d):
    b = V.stored_bars(s, d)
    return Q.reconcile(b.filter(F.col("volume") > 0), b.filter(F.dayofmonth("at") != 5).withColumn("close", F.col("high")), ["symbol", "at"], "close")


def listings(s, d):
    """Symbols of every listing shape, from part names: pairs, dated contracts, leveraged and stable bases, other quotes."""
    p = V.table(s, d, "part")
    base = F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    base = F.when(F.col("p_size") % 11 == 0, "USDC").when(F.col("p_size") % 7 == 0, F.concat(base, F.lit("UP"))).when(F.col("p_size") % 13 == 0, F.concat(base, F.lit("é"))).otherwise(base)
    tail = F.when(F.col("p_size") % 5 == 0, "BUSD").when(F.col("p_size") % 3 == 0, "_240628USDT").otherwise("USDT")
    return p.select(F.concat(base, F.col("p_size").cast("string"), tail).alias("a"), F.concat(base, tail).alias("symbol")).select("symbol").distinct()


LISTED = """SELECT DISTINCT b || CASE WHEN p_size % 5 = 0 THEN 'BUSD' WHEN p_size % 3 = 0 THEN '_240628USDT' ELSE 'USDT' END AS symbol FROM (
  SELECT p_size, CASE WHEN p_size % 11 = 0 THEN 'USDC' WHEN p_size % 7 = 0 THEN b0 || 'UP' WHEN p_size % 13 = 0 THEN b0 || 'é' ELSE b0 END AS b FROM (
    SELECT p_size, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS b0 FROM part))"""


@query("q14_perps", "symbol", f"SELECT symbol FROM ({LISTED}) WHERE symbol LIKE '%USDT' AND NOT contains(symbol, '_')")
def _(s, d):
    return Q.perps(listings(s, d))


@query("q14_spot_pairs", "symbol", f"SELECT symbol FROM ({LISTED}) WHERE symbol LIKE '%USDT' AND symbol NOT LIKE '%é%' AND symbol <> 'USDCUSDT' AND NOT regexp_matches(symbol, '(UP|DOWN|BULL|BEAR)USDT$')")
def _(s, d):
    return Q.spot_pairs(listings(s, d))


@query("q15_census", "year trading~6 tradeable~6", f"""
SELECT year(t.period) AS year, avg(n) AS trading, avg(coalesce(k, 0)) AS tradeable FROM (
  SELECT period, count(DISTINCT symbol) FILTER (volume > 0) AS n FROM (SELECT symbol, volume, at + (7 - isodow(at))::INTEGER AS period FROM bd) GROUP BY 1) t
LEFT JOIN (SELECT period, count(*) FILTER (returns IS NOT NULL AND liquidity >= {FLOOR}) AS k FROM panel GROUP BY 1) p ON p.period = t.period GROUP BY 1""")
def _(s, d):
    b = stored_long(s, d)
    return Q.census(P.build(b, min_bars=2), b, FLOOR)


@query("q15_delisted", "symbol last_trade frozen_days stopped", """
SELECT symbol, max(at) FILTER (volume > 0) AS last_trade, count(*) FILTER (volume = 0) AS frozen_days, max(at) FILTER (volume > 0) < (SELECT max(at) FROM bd) - 14 AS stopped FROM bd GROUP BY 1""")
def _(s, d):
    return Q.delisted(B.with_traded(V.stored_bars(s, d)))
