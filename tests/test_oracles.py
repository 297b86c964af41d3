"""Registered queries beside their DuckDB oracles at the smallest scale. TIDEMARK_ALL=1 runs every one; tools/check.py runs them at any scale."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")
CORE = ("b3_returns", "b6_funding_on_bars", "p9_panel", "k4_book_run", "j2_asof_forward", "j3_asof_backward", "l1_positions", "l5_equity",
        "c9_weekly_cost_table", "e5_candidates", "r7_cluster_ols", "g10_purged_folds", "s6_agg_trades", "s7_book_depth", "q1_quality_report",
        "t5_stream_bars", "w2_fill", "u2_set_operations")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDEMARK_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    got, want = rows(entry.queries()[name](spark, SF).toPandas()), rows(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert not len(got) or got.equals(want)


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["period", "gross", "funding", "cost", "turnover", "net"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180
