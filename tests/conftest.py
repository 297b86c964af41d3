import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                      "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """(symbol, at, high, low, close, volume) from {symbol: closes}, one a day from Monday 2023-01-02; None is a day without a bar, 0 an idle one."""
    def make(closes, volume=1e6, start=dt.date(2023, 1, 2)):
        rows = [(s, start + dt.timedelta(days=i), float(c or 1), float(c or 1), float(c or 1), volume if c else 0.0)
                for s, cs in closes.items() for i, c in enumerate(cs) if c is not None]
        return spark.createDataFrame(rows, "symbol string, at date, high double, low double, close double, volume double")
    return make
