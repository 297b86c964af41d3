"""Pairwise-complete correlations by blocks against the whole matrix."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import stats as R


def expected(frame, share):
    keep = frame.loc[:, (frame.notna().sum() >= int(share * len(frame))) & (frame.std(ddof=0) > 0)]
    c = np.nan_to_num(keep.corr(min_periods=2).to_numpy())
    np.fill_diagonal(c, 1.0)
    n, e = len(c), np.linalg.eigvalsh(c)
    return n, (c.sum() - n) / (n * (n - 1)), n * n / (c * c).sum(), e[-1] / n


@pytest.mark.parametrize("block", [7, 256])
def test_structure_with_missing_values(spark, block):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for year, names in ((2021, 30), (2022, 17), (2023, 2)):
        weeks = [dt.date(year, 1, 3) + dt.timedelta(days=7 * k) for k in range(40)]
        x = rng.normal(size=(40, 1)) * np.linspace(0, 1, names) + rng.normal(size=(40, names))
        x[rng.random(x.shape) < 0.2] = np.nan
        if names > 10:
            x[5:, 3], x[:, 4], x[20:, 5], x[:20, 6] = np.nan, 2.5, np.nan, np.nan
        frame = pd.DataFrame(x, index=weeks, columns=[f"s{k}" for k in range(names)])
        want[year] = expected(frame, 0.4)
        rows += [(s, w, None if np.isnan(v) else float(v)) for s in frame for w, v in frame[s].items()]
    df = spark.createDataFrame(rows, "symbol string, period date, returns double")
    got = {r.year: r for r in R.correlation_structure(df, 0.4, block).collect()}
    assert set(got) == set(want)
    for y, (n, avg, bets, top) in want.items():
        assert got[y].names == n and (got[y].avg_corr, got[y].independent_bets, got[y].top_share) == pytest.approx((avg, bets, top), rel=1e-8)
    assert R.correlation_structure(df.filter("false")).collect() == []


def test_masked_correlations_of_short_and_flat_overlaps():
    nan = np.nan
    a = np.array([[1.0, 2.0, nan, nan], [1.0, 2.0, 3.0, nan], [5.0, 5.0, 7.0, 8.0]])
    c = R.masked_correlations(a, a)
    assert c[0, 1] == pytest.approx(1) and c[0, 2] == 0 and c[1, 2] == pytest.approx(np.corrcoef([1, 2, 3], [5, 5, 7])[0, 1]) and np.allclose(c, c.T)
    assert R.masked_correlations(a[:, 3:], a[:, 3:]).tolist() == [[0.0] * 3] * 3
