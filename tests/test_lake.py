"""The lake's commits: what counts, what hides what, and what survives."""
import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import lake

SCHEMA = "symbol string, t timestamp, close double, dataset string"


def row(symbol, day, x, month=1, dataset="d"):
    return symbol, None if day is None else dt.datetime(2024, month, day, 12), x, dataset


@pytest.fixture
def put(spark, tmp_path):
    path = str(tmp_path / "lake")

    def write(*rows, schema=SCHEMA):
        lake.write(spark.createDataFrame(rows, schema), path)
    write.path = path
    return write


def held(spark, path):
    return sorted(((r.symbol, r.t and (r.t.month, r.t.day), r.close, r.dataset) for r in lake.read(spark, path).collect()), key=str)


def test_null_stamps_units_and_datasets_are_values(spark, put):
    put(row("BTC", None, 1.0), row("BTC", 3, 2.0), row(None, 3, 3.0), row("BTC", 3, 4.0, dataset=None))
    put(row("ETH", None, 5.0))
    put(row(None, 3, 6.0))
    assert held(spark, put.path) == sorted([("BTC", None, 1.0, "d"), ("BTC", (1, 3), 2.0, "d"), (None, (1, 3), 6.0, "d"), ("BTC", (1, 3), 4.0, None), ("ETH", None, 5.0, "d")], key=str)
    put(row("BTC", None, 7.0), row("BTC", None, 8.0))
    assert {r[2] for r in held(spark, put.path) if r[1] is None} == {5.0, 7.0, 8.0}
    assert lake.compact(spark, put.path) > 0 and {r[2] for r in held(spark, put.path)} == {2.0, 4.0, 5.0, 6.0, 7.0, 8.0}


def test_a_write_that_dies_leaves_the_view_as_it_was(spark, put, monkeypatch):
    put(row("BTC", 1, 1.0))

    def dies(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(lake, "_publish", dies)
        with pytest.raises(RuntimeError):
            put(row("BTC", 1, 9.0), row("ETH", 2, 9.0))
    bad = spark.range(3).select(F.lit("BTC").alias("symbol"), F.lit(dt.datetime(2024, 1, 1)).alias("t"), F.expr("if(id = 2, raise_error('lost'), 9.0d)").alias("close"), F.lit("d").alias("dataset"))
    with pytest.raises(Exception, match="lost"):
        lake.write(bad, put.path)
    assert held(spark, put.path) == [("BTC", (1, 1), 1.0, "d")]
    # What they left goes once it is old; a half-written log entry counts for nothing.
    (tmp := __import__("pathlib").Path(put.path) / "log" / "000000000099.json").write_text('{"commit": "x", "ord')
    assert lake.vacuum(spark, put.path, age=3600) == 0 and lake.vacuum(spark, put.path, age=-60) >= 2
    assert held(spark, put.path) == [("BTC", (1, 1), 1.0, "d")]
    tmp.unlink()


def test_writers_of_one_month_all_survive(spark, put):
    put(row("A", 1, 0.0))
    writers = [threading.Thread(target=put, args=(row(s, 1, 1.0), row(s, 2, 2.0))) for s in "BCDE"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    commits = lake.log(spark, put.path)
    assert len(commits) == 5 == len({c.number for c in commits})
    assert held(spark, put.path) == sorted([("A", (1, 1), 0.0, "d")] + [(s, (1, d), float(d), "d") for s in "BCDE" for d in (1, 2)], key=str)


def test_compaction_beside_a_writer(spark, put, monkeypatch):
    put(row("A", 1, 1.0), row("A", 2, 2.0), row("A", 1, 5.0, month=2))
    put(row("A", 1, 3.0), row("B", 1, 4.0))
    old = lake.View(spark, put.path)
    publish = lake._publish

    def later(*a, **k):
        # A write comes between what compaction read and its entry; it is the newer one all the same.
        monkeypatch.setattr(lake, "_publish", publish)
        put(row("A", 2, 9.0), row("C", 1, 6.0))
        publish(*a, **k)
    monkeypatch.setattr(lake, "_publish", later)
    assert lake.compact(spark, put.path) == 1
    want = sorted([("A", (1, 1), 3.0, "d"), ("A", (1, 2), 9.0, "d"), ("A", (2, 1), 5.0, "d"), ("B", (1, 1), 4.0, "d"), ("C", (1, 1), 6.0, "d")], key=str)
    assert held(spark, put.path) == want
    assert old.rows().count() == 4
    assert lake.vacuum(spark, put.path) == 2 and held(spark, put.path) == want
    assert lake.compact(spark, put.path) == 1 and held(spark, put.path) == want and lake.compact(spark, put.path) == 0
    days = {(r.symbol, r.day): r.rows for r in lake.holdings(spark, put.path).collect()}
    assert days == {(s, dt.date(2024, m, d)): 1 for s, (m, d), *_ in want}


def test_columns_may_be_added_and_keep_their_types(spark, put):
    put(row("A", 1, 1.0))
    put(("A", dt.datetime(2024, 1, 2), 2.0, "d", 7), schema=SCHEMA + ", trades bigint")
    assert sorted((r.close, r.trades) for r in lake.read(spark, put.path).collect()) == [(1.0, None), (2.0, 7)]
    with pytest.raises(ValueError, match="trades is bigint"):
        put(("A", dt.datetime(2024, 1, 2), 2.0, "d", "x"), schema=SCHEMA + ", trades string")
    with pytest.raises(ValueError, match="replaced by"):
        lake.write(spark.createDataFrame([row("A", 1, 1.0)], SCHEMA), put.path, unit=("symbol", "close"))
    lake.write(spark.createDataFrame([], SCHEMA), put.path)
    assert len(lake.log(spark, put.path)) == 2
    with pytest.raises(FileNotFoundError):
        lake.read(spark, put.path + "-none")


def test_reads_list_only_their_months(spark, put):
    put(*[row("A", 1, float(m), month=m) for m in range(1, 13)])
    put(row("A", 1, 50.0, month=5))
    got = lake.scan(spark, put.path, "d", "2024-05-01", "2024-06-15", ["A"])
    assert sorted(r.close for r in got.collect()) == [6.0, 50.0] and got.columns == ["symbol", "t", "close"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
