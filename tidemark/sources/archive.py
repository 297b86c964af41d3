"""Archive ingestion: a directory of CSV files, plain or zipped, to typed rows, rejects and a quality report.

Every reader takes raw lines (stream, file, pos, line), one row per line of
text, and returns typed rows with status parsed, rejected, header or blank, so
nothing is dropped before it is counted. stream keys what a report is kept
per; pos orders lines within a file.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.ordered import scan
from ..session import settle
from . import fields as X

# Columns of each dataset's files, and the column holding base-asset volume per market.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count",
                 "taker_buy_volume", "taker_buy_quote_volume", "ignore")
VOLUME_COLUMN = {"spot": 5, "usdm": 5, "coinm": 7}
# Seconds of each interval unit.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
FILE_STAMP = r"([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.(?:zip|csv)$"
FILE_SYMBOL = r"([^/]+?)-[^/-]+-[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?\.(?:zip|csv)$"


def lines(spark: SparkSession, paths: str | Sequence[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """(file, pos, line) of plain text files; large files split over tasks, and pos still orders their lines.

    With first and last, days, only files whose name stamp starts within them are opened; the names come from the listing.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if first is not None or last is not None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(paths).select(F.col("path").alias("file"))
        paths = [r.file for r in files_between(names, first or "0001-01-01", last or "9999-12-31").collect()]
        if not paths:
            return spark.createDataFrame([], "file string, pos struct<start:bigint,n:bigint>, line string")
    t = spark.read.text(paths, recursiveFileLookup=True, pathGlobFilter="*.csv")
    return t.select(F.col("_metadata.file_path").alias("file"),
                    F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("pos"),
                    F.col("value").alias("line"))


def zipped_lines(spark: SparkSession, path: str, first: str = "", last: str = "~") -> DataFrame:
    """(file, pos, line, symbol, stamp) of zip files holding one CSV each, small ones packed into tasks; line is NULL where a file cannot be read.

    symbol and stamp are what the file's name says, empty where it says nothing. Filters on them, and first and last, which bound the
    stamps as text, reach the listing: other files are not opened. This turns on filter pushdown for Python sources in the session.
    """
    from .zipped import ZippedCsv
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedCsv)
    z = spark.read.format("zipped_csv").option("first", first).option("last", last).load(path)
    return z.select("file", F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n")).alias("pos"), "line", "symbol", "stamp")


def name_stamp(file: Column) -> Column:
    """The trailing YYYY-MM or YYYY-MM-DD of a file name, empty where there is none."""
    return F.regexp_extract(file, FILE_STAMP, 1)


def stamp_start(text: Column) -> Column:
    return F.when(F.length(text) == 10, text).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).try_cast("date")


def with_stream(raw: DataFrame) -> DataFrame:
    """Adds symbol, stream (the symbol here), span (day or month) and start from the file name; a source that gives symbol and stamp keeps its own."""
    s = F.col("stamp") if "stamp" in raw.columns else name_stamp(F.col("file"))
    raw = raw if "symbol" in raw.columns else raw.withColumn("symbol", F.regexp_extract("file", FILE_SYMBOL, 1))
    return (raw.withColumn("stream", F.col("symbol"))
            .withColumn("span", F.when(F.length(s) == 10, "day").when(F.length(s) == 7, "month"))
            .withColumn("start", stamp_start(s)))


def files_between(files: DataFrame, first: str, last: str) -> DataFrame:
    """Files whose name stamp starts within [first, last]; applied before reading, so the rest are never opened."""
    start = stamp_start(name_stamp(F.col("file")))
    return files.filter((start >= F.lit(first).cast("date")) & (start <= F.lit(last).cast("date")))


def interval_seconds(interval: Column) -> Column:
    """Bar width of an interval such as 15m, 0 where unknown."""
    n = F.regexp_extract(interval, r"^([0-9]+)[smhdw]$", 1).try_cast("bigint")
    unit = F.regexp_extract(interval, r"^[0-9]+([smhdw])$", 1)
    width = F.try_element_at(F.create_map(*[F.lit(v) for kv in UNIT_SECONDS.items() for v in kv]), unit)
    return F.coalesce(n * width, F.lit(0)).cast("bigint")


def classify(raw: DataFrame, pattern: str, fields: dict[str, Column], ts: str, epochs: Sequence[str] = (),
             extra: Column | None = None, optional: Sequence[str] = ()) -> DataFrame:
    """raw with typed fields, ts_ns and status: parsed or rejected, header or blank, or failed where there is no line.

    pattern judges a row's shape in one pass, so fields are plain casts. ts names
    the field that stamps the row; epochs are raw stamps scaled to nanoseconds.
    extra is a condition over the typed fields. Fields come out of a generator
    of one row: a filter on status is not pushed below it, where it would
    split and cast every line again.
    """
    v = lambda n: F.col(f"__v_{n}")
    read = F.struct(F.rlike("line", F.lit(pattern)).alias("__shape"), *[e.alias(f"__v_{n}") for n, e in fields.items()])
    typed = raw.withColumn("__f", F.split("line", ",")).select(*raw.columns, F.inline(F.array(read)))
    ok = F.col("__shape")
    for n in fields:
        if n not in optional:
            ok = ok & v(n).isNotNull()
    for n in epochs:
        ok = ok & X.stamp_ok(v(n))
    if extra is not None:
        ok = ok & extra
    head = F.substring(F.col("line"), 1, 1)
    judged = typed.withColumn("status", F.when(F.col("line").isNull(), "failed").when(F.col("line") == "", "blank").when(~head.between("0", "9"), "header")
                              .when(F.coalesce(ok, F.lit(False)), "parsed").otherwise("rejected"))
    good = F.col("status") == "parsed"
    value = lambda n: F.when(good, X.scaled(v(n)) if n in epochs else v(n))
    return judged.select(*raw.columns, "status", value(ts).alias("ts_ns"), *[value(n).alias(n) for n in fields if n != ts])


def _f(i: int, kind: str = "double") -> Column:
    return F.get("__f", i).try_cast(kind)


def _v(name: str) -> Column:
    return F.col(f"__v_{name}")


def read_klines(raw: DataFrame, market: str = "usdm", volume: bool = True) -> DataFrame:
    """Klines stamped at their close; volume is in base units on every market. volume=False gives mark and premium klines."""
    at = VOLUME_COLUMN[market] if volume else 5
    shape = [X.DIGITS, *[X.DECIMAL] * 5, X.DIGITS] + [X.DECIMAL] * (at - 6)
    fields = {"open_time_ns": _f(0, "bigint"), **{n: _f(i) for i, n in enumerate(KLINE_COLUMNS) if 1 <= i <= 4}}
    if volume:
        fields["volume"] = _f(at)
    fields["close_time_ns"] = _f(6, "bigint")
    return classify(raw, X.row(*shape, rest=True), fields, "close_time_ns", ("open_time_ns", "close_time_ns"))


def read_mark_klines(raw: DataFrame) -> DataFrame:
    return read_klines(raw, volume=False)


def read_premium_klines(raw: DataFrame) -> DataFrame:
    """Premium index klines; values are signed rates."""
    return read_klines(raw, volume=False)


def read_funding(raw: DataFrame) -> DataFrame:
    fields = {"t": _f(0, "bigint"), "interval_hours": _f(1, "bigint"), "funding_rate": _f(2)}
    return classify(raw, X.row(X.DIGITS, X.INTEGER, X.DECIMAL, rest=True), fields, "t", ("t",), _v("interval_hours") > 0)


METRICS = ("toptrader_account_ratio", "toptrader_position_ratio", "account_long_short_ratio", "taker_long_short_volume_ratio")


def read_metrics(raw: DataFrame) -> DataFrame:
    """Open interest samples: the two figures are mandatory, the four ratios may be blank."""
    fields = {"t": X.read_datetime(F.get("__f", 0)), "open_interest": _f(2), "open_interest_value": _f(3),
              **{n: _f(4 + i) for i, n in enumerate(METRICS)}}
    pattern = X.row(X.DATETIME, "[^,]+", X.DECIMAL, X.DECIMAL, rest=True, optional=4, then=X.DECIMAL)
    return classify(raw, pattern, fields, "t", optional=METRICS)


def read_agg_trades(raw: DataFrame, market: str = "usdm") -> DataFrame:
    """Aggregated trades; side is the taker's. Width is exact: eight columns on spot, else seven."""
    shape = [X.INTEGER, X.DECIMAL, X.DECIMAL, X.INTEGER, X.INTEGER, X.DIGITS, X.BOOLEAN] + [X.BOOLEAN] * (market == "spot")
    maker = F.get("__f", 6).isin("true", "True")
    fields = {"t": _f(5, "bigint"), "id": _f(0, "bigint"), "first_trade_id": _f(3, "bigint"), "last_trade_id": _f(4, "bigint"),
              "price": _f(1), "qty": _f(2), "side": F.when(maker, "sell").otherwise("buy")}
    ok = ((_v("price") > 0) & (_v("qty") > 0) & (_v("id") >= 0) & (_v("first_trade_id") >= 0)
          & (_v("last_trade_id") >= _v("first_trade_id")))
    return classify(raw, X.row(*shape), fields, "t", ("t",), ok)


def read_book_depth(raw: DataFrame) -> DataFrame:
    """(stream, file, run, ts_ns, status, rows, bids, asks): one row per run of lines sharing their leading field.

    A sample is every whole percent from -5 to 5 once, with both inner bands or
    neither; otherwise the whole run is rejected. Runs are contiguous within a
    file; a file is cut into runs by comparing neighbours, and its lines are at
    most a day's.
    """
    head = F.substring(F.col("line"), 1, 1)
    body = raw.filter((F.col("line") != "") & F.rlike(head, F.lit("^[0-9]$"))).withColumn("__f", F.split("line", ","))
    shape = F.rlike("line", F.lit(X.row(X.DATETIME, X.DECIMAL, X.DECIMAL, X.DECIMAL)))
    lead = F.substring_index("line", ",", 1)
    # A stamp's one shape makes it and its text stand for each other.
    body = body.withColumns({"__t": F.when(F.rlike(lead, F.lit(f"^{X.DATETIME}$")), X.read_datetime(lead)), "__p": _f(1), "depth": _f(2), "notional": _f(3)})
    body = body.withColumn("__h", F.when(F.abs("__p") < 1e6, F.round(F.col("__p") * 100, 0)).cast("bigint"))
    ok = shape & F.col("__t").isNotNull() & F.col("__h").isNotNull() & F.col("depth").isNotNull() & F.col("notional").isNotNull()
    # Only what is judged moves to the file's task, not the line: its leading field goes along where no stamp stands for it.
    body = body.select("stream", "file", "pos", "__t", F.when(F.col("__t").isNull(), lead).alias("__lead"), ok.alias("__ok"),
                       *[F.when(ok, F.col(c)).alias(c) for c in ("__h", "depth", "notional")])
    w = Window.partitionBy("file").orderBy("pos")
    new = (~(F.lag("__t").over(w).eqNullSafe(F.col("__t")) & F.lag("__lead").over(w).eqNullSafe(F.col("__lead")))).cast("int")
    body = body.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.col("__h").isin(20, -20)
    whole = (~inner) & (F.pmod("__h", F.lit(100)) == 0) & F.col("__h").between(-500, 500) & (F.col("__h") != 0)
    # Distinct values are counted as sets, in the same pass: a distinct count would send every line once more for each.
    distinct = lambda c: F.size(F.collect_set(c))
    g = body.groupBy("stream", "file", "run").agg(
        F.min("__t").alias("__lo"), F.max("__t").alias("__hi"), F.every("__ok").alias("__all"), F.count(F.lit(1)).alias("rows"),
        distinct(F.when(whole, F.col("__h"))).alias("__bands"), F.count_if(F.coalesce(inner, F.lit(False))).alias("__inner"),
        distinct(F.when(inner, F.col("__h"))).alias("__sides"),
        # A run that is a sample has ten bands; longer ones are rejected, so only those of each side's five are kept.
        F.array_sort(F.collect_set(F.when(whole & (F.col("__h") < 0), F.struct((-F.col("__h")).alias("h"), "depth", "notional")))).alias("__b"),
        F.array_sort(F.collect_set(F.when(whole & (F.col("__h") > 0), F.struct(F.col("__h").alias("h"), "depth", "notional")))).alias("__a"))
    # Judged on the run as a whole.
    ok = (F.col("__all") & (F.col("__lo") == F.col("__hi")) & (F.col("__bands") == 10)
          & F.col("__inner").isin(0, 2) & (F.col("__sides") == F.col("__inner")) & (F.col("rows") == 10 + F.col("__inner")))
    ok = F.coalesce(ok, F.lit(False))
    side = lambda c: F.when(ok, F.transform(c, lambda x: F.struct(x["depth"].alias("depth"), x["notional"].alias("notional"))))
    return g.select("stream", "file", "run", F.when(ok, F.col("__lo")).alias("ts_ns"), F.when(ok, "parsed").otherwise("rejected").alias("status"),
                    "rows", side("__b").alias("bids"), side("__a").alias("asks"))


def quality_report(rows: DataFrame, keys: Sequence[str] = ("stream",), sequence: str | None = None, planned: DataFrame | None = None) -> DataFrame:
    """Per stream: files seen and failed, header, blank, parsed and rejected rows, backwards and repeated stamps, and gaps in a sequence column.

    planned (keys, file[, expected]) adds planned and missing files and the rows expected of them. Stamps and ids are compared
    with the parsed row before in file order. A hot stream is cut by file, and a large file by where its splits start; only each piece's last values
    cross over. The text is parsed once: what the report needs of each row is stored.
    """
    keys = list(keys)
    rows = settle(rows.select(*keys, "file", "pos", "status", "ts_ns", *([sequence] if sequence else [])))
    by_file = rows.groupBy(*keys, "file").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in ("header", "blank", "parsed", "rejected", "failed")])
    counts = by_file.groupBy(*keys).agg(*[F.sum(f"{s}_rows").alias(f"{s}_rows") for s in ("header", "blank", "parsed", "rejected")],
                                        F.count(F.lit(1)).alias("files"), F.count_if(F.col("failed_rows") > 0).alias("failed_files"))
    good = rows.filter(F.col("status") == "parsed")
    lasts = {"__t": F.col("ts_ns")} | ({"__q": F.col(sequence)} if sequence else {})
    before = {f"{n}p": n for n in lasts}
    split = F.col("pos.start") if isinstance(rows.schema["pos"].dataType, T.StructType) else F.floor(F.col("pos") / F.lit(1 << 20))
    seen = scan(good, keys, ["file", "pos"], F.struct("file", split.alias("split")), lasts=lasts, before=before)
    aggs = [F.count_if(F.col("ts_ns") < F.col("__tp")).alias("backwards_stamps"), F.count_if(F.col("ts_ns") == F.col("__tp")).alias("repeated_stamps")]
    if sequence:
        aggs.append(F.count_if(F.col(sequence) != F.col("__qp") + 1).alias("sequence_gaps"))
    out = counts.join(seen.groupBy(*keys).agg(*aggs), keys, "left")
    if planned is not None:
        name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
        had = by_file.select(*keys, name("file").alias("__name"), F.lit(True).alias("__had")).distinct()
        plan = planned.withColumn("__name", name("file")).join(had, [*keys, "__name"], "left")
        expected = F.sum("expected") if "expected" in planned.columns else F.lit(None).cast("bigint")
        out = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned_files"), F.count_if(F.col("__had").isNull()).alias("missing_files"),
                                      expected.alias("expected_rows")).join(out, keys, "left")
    return out.fillna(0)


def ingest(raw: DataFrame, read: Callable[[DataFrame], DataFrame], good: str, rejects: str, dataset: str) -> None:
    """Writes typed rows to the lake at good, partitioned by dataset, year and month, and rejected lines to rejects."""
    from .lake import write
    rows = settle(read(raw))
    parsed = (rows.filter(F.col("status") == "parsed").withColumn("t", X.stamp(F.col("ts_ns")))
              .withColumn("dataset", F.lit(dataset)).drop("line", "status", "pos", "file"))
    write(parsed, good)
    rows.filter(F.col("status") == "rejected").select("stream", "file", "line").write.mode("append").parquet(rejects)
