"""Normal distribution functions for one-row-per-book data, which Spark SQL lacks."""
from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


@lru_cache(maxsize=1)
def _log_cdf() -> tuple[np.ndarray, np.ndarray]:
    """log F on a grid; above 0 from the upper tail, so that 1 - F keeps its digits."""
    x = np.linspace(-38.0, 38.0, 76_001)
    tail = np.array([0.5 * math.erfc(abs(v) / math.sqrt(2.0)) for v in x])
    with np.errstate(divide="ignore"):
        return x, np.where(x > 0, np.log1p(-tail), np.log(tail))


@lru_cache(maxsize=4096)
def expected_max(n: float) -> float:
    """Expected maximum of n independent standard normals, for real n from 1, by integrating 1 - F^n tails."""
    if n <= 1:
        return 0.0
    x, log_cdf = _log_cdf()
    lower = np.exp(n * log_cdf)
    upper = -np.expm1(n * log_cdf)
    # E[max] is the upper tail's integral over x > 0 less the lower's over x < 0.
    return float(np.trapezoid(upper[x >= 0], x[x >= 0]) - np.trapezoid(lower[x <= 0], x[x <= 0]))


@lru_cache(maxsize=None)
def count_for_max(value: float) -> float:
    """The independent count, from 1, whose expected maximum is value: bisection on its logarithm, without an upper bound on the count."""
    if not value > 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while expected_max(math.exp(hi)) < value:
        lo, hi = hi, 2 * hi
        if hi > 600:
            raise ValueError(f"no count has an expected maximum of {value}")
    while hi - lo > 1e-9 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected_max(math.exp(mid)) < value else (lo, mid)
    return math.exp((lo + hi) / 2)
