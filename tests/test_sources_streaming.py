import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR
from tidemark.sources import archive as A, cost_table as CT, fields as X, lake, payloads as PL
from tidemark.streaming import flows as T

KLINE = "1704067200000,1,3,0.5,2,10,1704070799999,20,5,1,1,0"
MICRO = "1704070800000000,2,3,0.5,2.5,11,1704074399999999,20,5,1,1,0"


def raw(spark, lines, file="BTC-1h-2024-01-01.csv"):
    return A.with_stream(spark.createDataFrame([(file, i, l) for i, l in enumerate(lines)], "file string, pos int, line string"))


def test_files_and_zips_read_alike(spark, tmp_path):
    text = "open_time,open,high,low,close,volume\r\n" + KLINE + "\r\n\r\n" + MICRO + "\r\n1,2\r\n"
    plain, zips = tmp_path / "plain", tmp_path / "zips" / "BTC"
    plain.mkdir()
    zips.mkdir(parents=True)
    (plain / "BTC-1h-2024-01-01.csv").write_bytes(text.encode())
    for name in ("BTC-1h-2024-01-01", "BTC-1h-2024-02-01"):
        with zipfile.ZipFile(zips / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    a = A.read_klines(A.with_stream(A.lines(spark, str(plain))))
    counts = {r.status: r["count"] for r in a.groupBy("status").count().collect()}
    assert counts == {"header": 1, "parsed": 2, "blank": 1, "rejected": 1}
    rows = a.filter("status = 'parsed'").orderBy("ts_ns").collect()
    assert [r.ts_ns for r in rows] == [1704070799999000000, 1704074399999999000] and rows[0].volume == 10.0 and rows[0].symbol == "BTC"
    b = A.read_klines(A.with_stream(A.zipped_lines(spark, str(tmp_path / "zips"))), "coinm")
    assert b.filter("status = 'parsed'").count() == 4 and b.filter("status = 'parsed'").first().volume == 20.0
    spanned = spark.read.format("zipped_csv").option("first", "2024-02").load(str(tmp_path / "zips"))
    assert spanned.select("file").distinct().count() == 1


def test_zip_lines_are_the_files_lines_at_any_block_size(tmp_path, monkeypatch):
    from tidemark.sources import zipped as Z
    for k, (text, want) in enumerate([("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\n\r\n\nb\r\r\nc\rd\u2028e\n", ["a", "", "", "b\r", "c\rd\u2028e"]), ("\n\nß" * 40, ["", ""] + ["ß", ""] * 39 + ["ß"])]):
        path = tmp_path / f"A-1h-2024-0{k + 1}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("x.csv", text)
        for size in (1, 3, 1 << 20):
            monkeypatch.setattr(Z, "BATCH_BYTES", size)
            reader = Z._Reader({"path": str(path)})
            got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
            assert [r["line"] for r in got] == want and [r["n"] for r in got] == list(range(len(want)))
            assert {(r["symbol"], r["stamp"]) for r in got} <= {("A", f"2024-0{k + 1}")}
    broken = tmp_path / "B-1h-2024-01.zip"
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("x.csv", b"ok\n\xff\xfe\n")
    monkeypatch.setattr(Z, "BATCH_BYTES", 3)
    reader = Z._Reader({"path": str(broken)})
    assert [r["line"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()] == ["ok", None]


def test_filters_on_names_open_only_matching_zips(spark, tmp_path, monkeypatch):
    from pyspark.sql import datasource as D
    from tidemark.sources import zipped as Z
    for symbol in ("BTC", "ETH", "X-Y"):
        (tmp_path / symbol / "1h").mkdir(parents=True)
        for month in range(1, 7):
            name = f"{symbol}-1h-2024-{month:02}"
            with zipfile.ZipFile(tmp_path / symbol / "1h" / f"{name}.zip", "w") as z:
                z.writestr(f"{name}.csv", KLINE + "\n")
    (tmp_path / "ETH" / "1h" / "ETH-1h-2024-06.zip").write_bytes(b"no archive")
    (tmp_path / "odd.zip").write_bytes(b"no archive")
    root = str(tmp_path)

    def opened(filters, **options):
        reader = Z._Reader({"path": root, **options})
        left = list(reader.pushFilters(filters))
        return [p.rsplit("/", 1)[-1] for part in reader.partitions() for p in reader.paths(part)], left

    assert len(opened([])[0]) == 19
    eth, left = opened([D.IsNotNull(("symbol",)), D.EqualTo(("symbol",), "ETH"), D.LessThan(("stamp",), "2024-03"), D.EqualTo(("line",), "x"), D.Not(D.EqualTo(("symbol",), "BTC"))])
    assert eth == ["ETH-1h-2024-01.zip", "ETH-1h-2024-02.zip"] and len(left) == 2
    assert len(opened([D.In(("symbol",), ("X-Y", "BTC"))], first="2024-05")[0]) == 4 and opened([D.EqualTo(("symbol",), "none")])[0] == []
    # Large folders are dealt by name, each file to one share, and small ones are packed.
    whole = sorted(opened([])[0])
    size = (tmp_path / "BTC" / "1h" / "BTC-1h-2024-01.zip").stat().st_size
    for limit, parts in ((2 * size, 10), (7 * size, 4), (1 << 20, 1)):
        monkeypatch.setattr(Z, "TASK_BYTES", limit)
        assert sorted(opened([])[0]) == whole and len(Z._Reader({"path": root}).partitions()) <= parts
    monkeypatch.undo()
    lines = A.with_stream(A.zipped_lines(spark, root))
    some = A.read_klines(lines).filter((F.col("symbol") == "ETH") & (F.col("stamp") < "2024-06")).select("file", "status")
    assert [r.status for r in some.collect()] == ["parsed"] * 5
    assert A.read_klines(lines).filter(F.col("symbol").isin("ETH", "")).filter("status = 'failed'").count() == 2
    assert A.read_klines(lines).filter(F.col("symbol") == "none").collect() == []
    one = A.zipped_lines(spark, f"{root}/BTC/1h/BTC-1h-2024-01.zip")
    assert one.count() == 1 and one.filter(F.col("symbol") == "ETH").count() == 0


def test_trade_rows(spark):
    ok = ["1,10.5,2,5,6,1704067200000,true", "2,10.5,2,7,7,1704067200001,False"]
    bad = ["3,0,2,5,6,1704067200000,true", "4,1,2,6,5,1704067200000,true", "5,1,2,5,6,1704067200000,TRUE", "6,1,2,5,6,1704067200000,true,true",
           "7,1,2,5,6,170406720000000000,true", "8,1,x,5,6,1704067200000,true", "9,1,2,5,6,99999999999999,true", "10,1,2,5,6,,true"]
    got = A.read_agg_trades(raw(spark, ok + bad)).orderBy("pos").collect()
    assert [r.status for r in got] == ["parsed"] * 2 + ["rejected"] * len(bad)
    assert [r.side for r in got[:2]] == ["sell", "buy"]
    spot = A.read_agg_trades(raw(spark, [ok[0], ok[0] + ",True"]), "spot").orderBy("pos").collect()
    assert [r.status for r in spot] == ["rejected", "parsed"]


def test_metrics_and_funding_rows(spark):
    m = ["2024-01-01 00:05:00,BTC,1.5,2e3,,,,", "2024-02-30 00:05:00,BTC,1,2,1,1,1,1", "2024-01-01 00:05:60,BTC,1,2,1,1,1,1", "2024-01-01 00:05:00,,1,2,1,1,1,1",
         "2024-01-01 00:05:00,BTC,,2,1,1,1,1", "2024-01-01 00:05:00,BTC,1,2", "2024-01-01 00:05:00,BTC,1,2,1,x,1,1"]
    got = A.read_metrics(raw(spark, m)).orderBy("pos").collect()
    assert [r.status for r in got] == ["parsed", "rejected", "rejected", "rejected", "rejected", "parsed", "rejected"]
    assert got[0].open_interest_value == 2000.0 and got[0].account_long_short_ratio is None
    f = A.read_funding(raw(spark, ["1704067200000,8,0.0001", "1704067200000,0,0.0001", "1704067200000,4,-1e-4"])).orderBy("pos").collect()
    assert [(r.status, r.funding_rate) for r in f] == [("parsed", 0.0001), ("rejected", None), ("parsed", -0.0001)]


def test_book_depth_runs(spark):
    def block(t, pcts):
        return [f"2024-01-01 00:00:{t:02},{p},{abs(p) * 10},{abs(p) * 100}" for p in pcts]
    ten = [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]
    lines = block(1, ten) + block(2, ten[:9]) + block(3, ten + [0.2, -0.2]) + block(4, ten + [0.2]) + block(5, ten[:9] + [4])
    got = A.read_book_depth(raw(spark, lines)).orderBy("run").collect()
    assert [r.status for r in got] == ["parsed", "rejected", "parsed", "rejected", "rejected"]
    assert [b.notional for b in got[0].bids] == [100.0, 200.0, 300.0, 400.0, 500.0]


def test_book_depth_moves_typed_values_once(spark):
    """Lines of a run are judged together whatever is wrong with one, and they are shuffled once, without their text."""
    ten = [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]
    block = lambda t, pcts: [f"{t},{p},{abs(p) * 10},{abs(p) * 100}" for p in pcts]
    good, none = "2024-01-01 00:00:01", "2024-02-30 00:00:01"
    lines = block(good, ten) + [f"{good},x,1,1"] + block(none, ten) + ["2024-02-30 00:00:02,1,1,1", "7"] + block(good, ten) + block("2024-01-01 00:00:02", ten)
    df = A.read_book_depth(raw(spark, lines))
    got = df.orderBy("run").collect()
    assert [(r.run, r.rows, r.status) for r in got] == [(1, 11, "rejected"), (2, 10, "rejected"), (3, 1, "rejected"), (4, 1, "rejected"), (5, 10, "parsed"), (6, 10, "parsed")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan


def test_quality_report_and_expected_rows(spark):
    l = lambda i, t: f"{i},1,1,1,1,{1704067200000 + t},true"
    r = A.read_agg_trades(raw(spark, ["id,p,q,f,l,t,m", l(1, 0), l(2, 5), "", l(2, 5), l(5, 3), "x", "9,bad"]))
    q = A.quality_report(r, sequence="id").first()
    assert (q.header_rows, q.blank_rows, q.parsed_rows, q.rejected_rows) == (2, 1, 4, 1)
    assert (q.backwards_stamps, q.repeated_stamps, q.sequence_gaps) == (1, 1, 2)
    w = spark.range(1).select(*[A.interval_seconds(F.lit(i)).alias(i) for i in ("1m", "4h", "1mo", "")]).first()
    assert list(w) == [60, 14400, 0, 0]


def test_ingest_writes_the_lake_and_quarantines_rejects(spark, tmp_path):
    A.ingest(raw(spark, [KLINE, MICRO, "1,2"]), A.read_klines, str(tmp_path / "lake"), str(tmp_path / "bad"), "klines_1h")
    back = lake.scan(spark, str(tmp_path / "lake"), "klines_1h", "2024-01-01 00:00:00", "2024-01-01 01:30:00", ["BTC"])
    assert back.count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    # Both lines are of one symbol and day, which a later write of either replaces.
    A.ingest(raw(spark, [KLINE]), A.read_klines, str(tmp_path / "lake"), str(tmp_path / "bad"), "klines_1h")
    assert lake.read(spark, str(tmp_path / "lake")).count() == 1


def test_the_lake_keeps_other_symbols_and_days(spark, tmp_path):
    path = str(tmp_path / "lake")
    row = lambda symbol, day, x: (symbol, dt.datetime(2024, 1, day), x, "klines_1d")
    put = lambda *rows: lake.write(spark.createDataFrame(rows, "symbol string, t timestamp, close double, dataset string"), path)
    put(row("BTC", 1, 1.0), row("BTC", 2, 2.0))
    put(row("ETH", 2, 3.0))
    put(row("BTC", 2, 9.0), row(None, 2, 4.0))
    put(row("BTC", 3, 5.0))
    put(row(None, 2, 6.0))
    got = {(r.symbol, r.t.day): r.close for r in lake.read(spark, path).collect()}
    assert got == {("BTC", 1): 1.0, ("BTC", 2): 9.0, ("ETH", 2): 3.0, ("BTC", 3): 5.0, (None, 2): 6.0}


def test_cost_table(spark, tmp_path):
    p = tmp_path / "c.csv"
    head = "taker_fee_bps,week_start,note,symbol,market,impact_bps_per_unit,half_spread_bps\n"
    known = spark.createDataFrame([("BTC", 1)], "symbol string, market int")
    p.write_text(head + "4,2024-01-01,x,BTC,1,,2\n4,oops,x,ETH,1,,\n")
    r = CT.typed(CT.read_csv(spark, str(p)), known).collect()
    assert [(x.symbol, x.impact_bps_per_unit, x.half_spread_bps) for x in r] == [("BTC", 0.0, 2.0)]
    for bad in ("4,oops,x,BTC,1,,2", "4,2024-01-01,x,BTC,1,,", "4,2024-01-01,x,BTC,q,,2", ",2024-01-01,x,BTC,1,,2"):
        p.write_text(head + bad + "\n")
        with pytest.raises(Exception, match="cost table"):
            CT.typed(CT.read_csv(spark, str(p)), known).collect()


def test_payloads(spark):
    df = spark.createDataFrame([("X", '{"timestamp":[1704067200,1704067300,1704153600],"adjclose":[1.5,9.0,null],"volume":[null,1,2]}')], "symbol string, payload string")
    assert [(r.close, r.volume) for r in PL.array_bars(df).collect()] == [(1.5, 0.0)]


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(spark, tmp_path, step, source):
    q = T.carried(source, step, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "log"))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_gaps_and_late_rows_carry_over_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "stream string, id bigint, t timestamp"
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    gap, late = T.gap_step(["stream"], ["id"], "id", 100), T.late_step(["stream"], "t")
    for part in ([("a", 1, t(1)), ("a", 2, t(9)), ("b", 7, t(1))], [("a", 3, t(4)), ("a", 5, t(10)), ("b", 9, t(2))]):
        write(spark, part, schema, src)
        g = drain(spark, tmp_path / "g", gap, T.folder(spark, src, schema))
        l = drain(spark, tmp_path / "l", late, T.folder(spark, src, schema))
    assert sorted((r.stream, r.id) for r in g.filter("gap").collect()) == [("a", 5), ("b", 9)] and g.count() == 6
    assert [(r.stream, r.id) for r in l.filter("late").collect()] == [("a", 3)]


def test_positions_and_thinning_carry_over_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "account string, instrument string, t timestamp, seq bigint, side string, qty double, price double, fee double"
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for part in ([("x", "i", t(0), 1, "buy", 2.0, 10.0, 0.1), ("x", "i", t(1), 2, "sell", 1.0, 11.0, 0.1)], [("x", "i", t(2), 3, "buy", 5.0, 9.0, 0.1), ("x", "i", t(9), 4, "buy", 1.0, 9.0, 0.1)]):
        write(spark, part, schema, src)
        p = drain(spark, tmp_path / "p", T.position_step(), T.folder(spark, src, schema))
        k = drain(spark, tmp_path / "k", T.thin_step(3 * HOUR, ["account"], "t"), T.folder(spark, src, schema))
    assert [r.position for r in p.orderBy("seq").collect()] == [2.0, 1.0, 6.0, 7.0]
    assert abs(p.filter("seq = 4").first().cash - (-20.1 + 10.9 - 45.1 - 9.1)) < 1e-9
    assert [r.seq for r in k.orderBy("seq").collect()] == [1, 4]


def test_field_rules(spark):
    v = ["1", "-2", "+3", "1.5", ".5", "1e3", "1e", "", " 1", "NaN", "1234567890123456789"]
    df = spark.createDataFrame([(x,) for x in v], "x string").select("x", X.integer(F.col("x")).alias("i"), X.decimal(F.col("x")).alias("d"))
    out = {r.x: (r.i, r.d) for r in df.collect()}
    assert out["-2"] == (-2, -2.0) and out["+3"] == (3, 3.0) and out[".5"] == (None, 0.5) and out["1e3"] == (None, 1000.0)
    assert all(out[x] == (None, None) for x in ("1e", "", " 1", "NaN")) and out["1234567890123456789"][0] is None
