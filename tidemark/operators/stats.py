"""Return and signal statistics over long tables of books: (by, t, r) in, one row per book out.

Every function takes the grouping keys in by, so a sweep of thousands of books
is one aggregation. A book's periods are bounded by the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import moments as M
from ..functions.columns import corr, DAY, HOUR, div, micros, rolling
from ..session import settle
from .book import _per

# Periods a year by median spacing.
PER_YEAR = {7 * DAY: 52, DAY: 365, HOUR: 8760}


def sharpe(books: DataFrame, periods: float = 52, by: Sequence[str] = ("book_id",)) -> DataFrame:
    return books.groupBy(*by).agg(M.sharpe("r", periods).alias("sharpe"))


def annualised(books: DataFrame, periods: float = 52, by: Sequence[str] = ("book_id",)) -> DataFrame:
    return books.groupBy(*by).agg(M.annual_return("r", periods).alias("annual_return"),
                                  M.volatility("r", periods).alias("volatility"), M.t_stat("r").alias("t_stat"))


def underwater(books: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """Adds equity, the summed returns, and fall, their distance below the running peak, which starts at 0."""
    w = _per(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    e = books.filter(F.col("r").isNotNull()).withColumn("equity", F.sum("r").over(w))
    return e.withColumn("fall", F.col("equity") - F.greatest(F.max("equity").over(w), F.lit(0.0)))


def drawdown(books: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    return underwater(books, by).groupBy(*by).agg(F.min("fall").alias("drawdown"))


def periods_per_year(books: DataFrame, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """Periods a year from the median spacing of each book's stamps; any other spacing fails the job."""
    w = _per(by).orderBy("t")
    x = books.withColumn("__t", micros(books, "t"))
    x = x.withColumn("__step", F.col("__t") - F.lag("__t").over(w))
    step = x.groupBy(*by).agg(F.percentile("__step", F.lit(0.5)).alias("__step"))
    known = F.create_map(*[F.lit(v) for k in PER_YEAR.items() for v in (float(k[0]), k[1])])
    found = F.try_element_at(known, F.col("__step"))
    return step.select(*by, F.when(found.isNotNull(), found)
                       .otherwise(F.raise_error(F.concat(F.lit("no annualisation for a spacing of "),
                                                         F.coalesce(F.col("__step").cast("string"), F.lit("one stamp")))))
                       .cast("bigint").alias("periods"))


def by_year(books: DataFrame, value: Column | None = None, periods: float = 52, by: Sequence[str] = ("book_id",)) -> DataFrame:
    """An aggregate of r per calendar year, the Sharpe unless value is given."""
    return (books.groupBy(*by, F.year("t").cast("bigint").alias("year"))
            .agg((value if value is not None else M.sharpe("r", periods)).alias("value")))


def summary(books: DataFrame, periods: float = 52, by: Sequence[str] = ("book_id",)) -> DataFrame:
    by = list(by)
    years = (by_year(books.filter(F.col("r").isNotNull()), periods=periods, by=by).groupBy(*by)
             .agg(F.avg((F.coalesce(F.col("value") > 0, F.lit(False))).cast("double")).alias("years_positive")))
    base = books.groupBy(*by).agg(
        M.sharpe("r", periods).alias("sharpe"), M.annual_return("r", periods).alias("annual_return"),
        M.volatility("r", periods).alias("volatility"), F.count("r").alias("periods"))
    return base.join(drawdown(books, by), by).join(years, by)


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank from 1 within keys, ties sharing their average."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.rank().over(w.orderBy(x)) + (ties - 1) / 2


def rank_ic(rows: DataFrame, signal: str = "signal", forward: str = "forward", min_names: int = 20,
            by: Sequence[str] = ()) -> DataFrame:
    """(by, period, ic, names): Spearman correlation across names with both values, from min_names names."""
    both = rows.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull())
    keys = [*by, "period"]
    ranked = both.withColumn("__s", average_rank(signal, keys)).withColumn("__f", average_rank(forward, keys))
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("names"),
        F.when((F.min("__s") < F.max("__s")) & (F.min("__f") < F.max("__f")), corr("__s", "__f")).alias("ic"))
    return out.filter((F.col("names") >= min_names) & F.col("ic").isNotNull())


def cluster_ols(rows: DataFrame, y: str, xs: Sequence[str], cluster: str) -> DataFrame:
    """(term, coef, se): least squares with errors clustered by a column, so a shared shock counts once.

    Two aggregations: moments per cluster, then their totals. Only k-by-k
    sums, with k regressors, reach the one small solve.
    """
    k = len(xs)
    x = [F.col(c).cast("double") for c in xs]
    per = rows.groupBy(cluster).agg(
        F.array(*[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)]).alias("xx"),
        F.array(*[F.sum(x[i] * F.col(y)) for i in range(k)]).alias("xy"), F.count(F.lit(1)).alias("n"))

    def total(name, size):
        return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(size)]).alias(name)

    def solve(batches):
        for b in batches:
            if len(b):
                r = b.iloc[0]
                xx = np.array(r.xx, float).reshape(k, k)
                yield pd.DataFrame({"beta": [np.linalg.solve(xx, np.array(r.xy, float)).tolist()]})

    beta = per.agg(total("xx", k * k), total("xy", k)).mapInPandas(solve, "beta array<double>").scalar()
    b = per.withColumn("__beta", beta)
    score = [F.element_at("xy", i + 1)
             - sum((F.element_at("xx", i * k + j + 1) * F.element_at("__beta", j + 1) for j in range(1, k)),
                   F.element_at("xx", i * k + 1) * F.element_at("__beta", 1)) for i in range(k)]
    b = b.withColumn("__s", F.array(*score))
    meat = F.array(*[F.sum(F.element_at("__s", i + 1) * F.element_at("__s", j + 1)) for i in range(k) for j in range(k)])
    sums = b.agg(total("xx", k * k), total("xy", k), meat.alias("meat"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    names = list(xs)

    def errors(batches):
        for f in batches:
            for r in f.itertuples():
                xx = np.array(r.xx, float).reshape(k, k)
                bread, meat_ = np.linalg.inv(xx), np.array(r.meat, float).reshape(k, k)
                scale = r.c / (r.c - 1) * (r.n - 1) / (r.n - k)
                se = np.sqrt(np.diag(scale * bread @ meat_ @ bread))
                yield pd.DataFrame({"term": names, "coef": bread @ np.array(r.xy, float), "se": se})

    return sums.mapInPandas(errors, "term string, coef double, se double")


def pooled_correlation(rows: DataFrame, x: str, y: str, limit: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Correlation over rows with both values inside (-limit, limit), and their count."""
    ok = rows.filter((F.abs(x) < limit) & (F.abs(y) < limit))
    return ok.groupBy(*by).agg(corr(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))


# Two-sided normal tail shares beyond 2, 3, 4 and 5 spreads.
NORMAL_TAILS = {2: 0.04550026389635842, 3: 0.0026997960632601866, 4: 6.334248366623996e-05, 5: 5.733031437583892e-07}


def tails(rows: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, observed, below, above, normal): share of standardised values beyond k sample spreads."""
    m = rows.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    if by:
        j = rows.filter(F.col(x).isNotNull()).join(m, list(by))
    else:
        j = (rows.filter(F.col(x).isNotNull()).withColumn("__m", m.select("__m").scalar())
             .withColumn("__s", m.select("__s").scalar()))
    z = div(F.col(x) - F.col("__m"), F.col("__s"))
    flags = []
    for k in NORMAL_TAILS:
        flags += [F.avg((F.abs(z) > k).cast("double")).alias(f"o{k}"), F.avg((z < -k).cast("double")).alias(f"b{k}"),
                  F.avg((z > k).cast("double")).alias(f"a{k}")]
    wide = j.groupBy(*by).agg(*flags)
    pack = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"o{k}").alias("observed"),
                              F.col(f"b{k}").alias("below"), F.col(f"a{k}").alias("above"), F.lit(p).alias("normal"))
                     for k, p in NORMAL_TAILS.items()])
    return wide.select(*by, F.explode(pack).alias("__r")).select(*by, "__r.*")


def masked_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of each row of a with each of b over the columns both have; NaN is missing. Zero without two of them or without spread."""
    pa, pb = ~np.isnan(a), ~np.isnan(b)
    # Differences from a row's own mean, so that little cancels below.
    a = np.where(pa, a - np.where(pa.any(1), np.nansum(a, 1) / np.maximum(pa.sum(1), 1), 0)[:, None], 0.0)
    b = np.where(pb, b - np.where(pb.any(1), np.nansum(b, 1) / np.maximum(pb.sum(1), 1), 0)[:, None], 0.0)
    pa, pb = pa.astype(float), pb.astype(float)
    n, sa, sb, cross = pa @ pb.T, a @ pb.T, pa @ b.T, a @ b.T
    qa, qb = (a * a) @ pb.T, pa @ (b * b).T
    va, vb = n * qa - sa * sa, n * qb - sb * sb
    # What rounding leaves of no spread is none.
    some = (va > 1e-12 * n * qa) & (vb > 1e-12 * n * qb)
    return np.where(some, (n * cross - sa * sb) / np.sqrt(np.where(some, va * vb, 1.0)), 0.0)


def correlation_structure(rows: DataFrame, share: float = 0.8, block: int = 256) -> DataFrame:
    """(year, names, avg_corr, independent_bets, top_share) of period returns, each pair over the periods both have.

    Names with at least share of the year's periods and with spread count; a pair without
    two shared periods is uncorrelated. Names are dealt into blocks, and blocks meet in pairs: products of
    values and of presence masks give a block of correlations, of which sums go on.
    top_share, the largest eigenvalue's share, comes from Lanczos steps over the stored blocks,
    a job each for all years together; a vector of one number a name is all the driver holds.
    """
    spark = rows.sparkSession
    r = rows.select("symbol", "period", F.col("returns").cast("double").alias("returns")).withColumn("year", F.year("period").cast("bigint"))
    at = r.select("year", "period").distinct().withColumn("__at", F.row_number().over(Window.partitionBy("year").orderBy("period")) - 1)
    at = at.withColumn("__t", F.count(F.lit(1)).over(Window.partitionBy("year")))
    live = r.filter(F.col("returns").isNotNull()).join(at, ["year", "period"])
    # A name's year is at most its periods, so its vector is bounded.
    vec = live.groupBy("year", "symbol").agg(F.max("__t").alias("__t"), F.collect_list(F.struct("__at", "returns")).alias("__v"), F.stddev_pop("returns").alias("__s"))
    vec = settle(vec.filter((F.size("__v") >= F.floor(F.lit(share) * F.col("__t"))) & (F.col("__s") > 0)).drop("__s"))
    names = vec.groupBy("year").agg(F.count(F.lit(1)).alias("names"))
    dealt = vec.join(names, "year").withColumn("__b", F.pmod(F.xxhash64("symbol"), F.ceil(F.col("names") / F.lit(block))).cast("int"))
    blocks = settle(dealt.groupBy("year", "__b").agg(F.max("__t").alias("__t"), F.array_sort(F.collect_list(F.struct("symbol", "__v"))).alias("__x")))
    pairs = blocks.join(blocks.select("year", F.col("__b").alias("__c"), F.col("__x").alias("__y")), "year").filter(F.col("__b") <= F.col("__c"))

    def matrix(names_, periods):
        out = np.full((len(names_), periods), np.nan)
        for k, name in enumerate(names_):
            for cell in name["__v"]:
                out[k, cell["__at"]] = cell["returns"]
        return out

    def correlate(batches):
        for f in batches:
            for x in f.itertuples(index=False, name=None):
                year, b, t, left, c, right = x
                m = masked_correlations(matrix(left, t), matrix(right, t))
                if b == c:
                    np.fill_diagonal(m, 1.0)
                twice = 1.0 if b == c else 2.0
                yield pd.DataFrame({"year": [year], "b": [b], "c": [c], "total": [twice * m.sum()], "squares": [twice * (m * m).sum()], "wide": [m.shape[1]], "m": [m.tobytes()]})

    made = settle(pairs.select("year", "__b", "__t", "__x", "__c", "__y").mapInPandas(correlate, "year bigint, b int, c int, total double, squares double, wide int, m binary"))
    sums = made.groupBy("year").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).join(names, "year")
    top = spark.createDataFrame(list(_largest(made).items()), "year bigint, top double")
    n = F.col("names")
    return sums.join(top, "year").select("year", n, div(F.col("total") - n, (n * (n - 1)).cast("double")).alias("avg_corr"), (n * n / F.col("squares")).alias("independent_bets"), (F.col("top") / n).alias("top_share"))


def _largest(made: DataFrame, steps: int = 100) -> dict[int, float]:
    """The largest eigenvalue of each year's matrix, stored as blocks of its upper half."""
    sizes = {(r.year, r.b): r.wide for r in made.filter("b = c").select("year", "b", "wide").collect()}
    if not sizes:
        return {}
    place, length = {}, {}
    for key in sorted(sizes):
        place[key] = length.get(key[0], 0)
        length[key[0]] = place[key] + sizes[key]

    def times(v: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def run(batches):
            for f in batches:
                for x in f.itertuples(index=False):
                    m = np.frombuffer(x.m).reshape(-1, x.wide)
                    part = lambda b: v[x.year][place[x.year, b]:place[x.year, b] + sizes[x.year, b]]
                    out = [(x.year, x.b, (m @ part(x.c)).tolist())] + ([(x.year, x.c, (m.T @ part(x.b)).tolist())] if x.b != x.c else [])
                    yield pd.DataFrame(out, columns=["year", "b", "y"])
        out = {y: np.zeros(n) for y, n in length.items()}
        for r in made.filter(F.col("year").isin(list(v))).mapInPandas(run, "year bigint, b int, y array<double>").collect():
            out[r.year][place[r.year, r.b]:place[r.year, r.b] + sizes[r.year, r.b]] += r.y
        return out

    basis = {y: [(lambda x: x / np.linalg.norm(x))(1 + np.sin(np.arange(1, n + 1)) / 3)] for y, n in length.items()}
    alpha, beta, found = {y: [] for y in length}, {y: [] for y in length}, {}
    while len(found) < len(length):
        product = times({y: q[-1] for y, q in basis.items() if y not in found})
        for y in [y for y in basis if y not in found]:
            q, w = np.array(basis[y]), product[y]
            alpha[y].append(float(w @ q[-1]))
            for _ in range(2):
                w = w - q.T @ (q @ w)
            size = float(np.linalg.norm(w))
            e, u = np.linalg.eigh(np.diag(alpha[y]) + np.diag(beta[y], 1) + np.diag(beta[y], -1))
            if size * abs(u[-1, -1]) < 1e-10 * abs(e[-1]) or len(q) == length[y] or len(q) == steps:
                found[y] = float(e[-1])
            else:
                beta[y].append(size)
                basis[y].append(w / size)
    return found


def head_to_head(books: DataFrame, base: str) -> DataFrame:
    """Each book against the book named base: mean edge and its t, means where the base loses and wins, correlation."""
    b = books.filter(F.col("book_id") == base).select("t", F.col("r").alias("b"))
    j = books.filter(F.col("book_id") != base).join(b, "t").filter(F.col("r").isNotNull() & F.col("b").isNotNull())
    edge = F.col("r") - F.col("b")
    return j.groupBy("book_id").agg(
        F.avg(edge).alias("edge"), div(F.avg(edge), F.stddev_samp(edge)).alias("__t"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("b") < 0, F.col("r"))).alias("when_base_loses"),
        F.avg(F.when(F.col("b") > 0, F.col("r"))).alias("when_base_wins"),
        corr("r", "b").alias("corr")).withColumn("edge_t", F.col("__t") * F.sqrt("n")).drop("__t")


def past_and_next(panel: DataFrame, lookbacks: Sequence[int], limit_floor: float) -> DataFrame:
    """(lookback, symbol, period, past, nxt): the vol-scaled trailing return and the next period's, per lookback."""
    from .panel import own, past
    w = own()
    nxt = F.lead(div(F.when(F.col("liquidity") >= limit_floor, F.col("returns")), F.col("vol"))).over(w)
    out = panel.withColumn("nxt", nxt)
    for n in lookbacks:
        x = div(rolling(F.sum, F.col("returns"), past(n), n), F.col("vol") * F.sqrt(F.lit(float(n))))
        out = out.withColumn(f"__p{n}", F.when(F.col("liquidity") >= limit_floor, x))
    pairs = F.array(*[F.struct(F.lit(n).cast("bigint").alias("lookback"), F.col(f"__p{n}").alias("past")) for n in lookbacks])
    return (out.select("symbol", "period", "nxt", F.explode(pairs).alias("__p"))
            .select("symbol", "period", "__p.lookback", "__p.past", "nxt"))


def predictability(panel: DataFrame, lookbacks: Sequence[int], floor: float, min_names: int = 20, window: int = 12, least: int = 8,
                   yearly: bool = False) -> DataFrame:
    """(lookback[, year], leg, value, t, n): how far the past n periods tell the next one, each return in units of the spread known before it.

    leg own pools coins and periods: correlation, and its root-n multiple. leg market does so for the mean return of the liquid coins. leg relative
    takes what a coin makes beyond that mean: the rank correlation across the coins of each period with at least min_names of
    them, averaged, with its t over periods. A leg without values has no row. The panel is read three times: store an expensive one first.
    """
    from .panel import market_return, own
    year = [F.year("period").cast("bigint").alias("year")] if yearly else []
    keys = ["lookback", *(["year"] if yearly else [])]

    def legs(rows, name, over, vol):
        """rows with past and nxt of the column per lookback, scaled by vol."""
        back = lambda n: over.rowsBetween(-(n - 1), 0)
        rows = rows.withColumn("__vol", F.lag(rolling(F.stddev_samp, F.col(name), back(window), least)).over(over))
        pasts = F.array(*[F.struct(F.lit(n).cast("bigint").alias("lookback"), div(rolling(F.sum, F.col(name), back(n), n), F.col("__vol") * F.sqrt(F.lit(float(n)))).alias("past"))
                          for n in lookbacks])
        return rows.withColumns({"nxt": vol(F.col("__vol"), over), "__p": pasts}).select("*", F.inline("__p"))

    paired = lambda rows: rows.groupBy(*keys).agg(corr("past", "nxt").alias("value"), F.count(F.when(F.col("past").isNotNull() & F.col("nxt").isNotNull(), 1)).alias("n"))
    alone = pooled_correlation(past_and_next(panel, lookbacks, floor).select("*", *year), "past", "nxt", by=keys).withColumnRenamed("corr", "value")
    market = market_return(panel, floor)
    both = paired(legs(market, "market", _per(()).orderBy("period"), lambda v, w: div(F.lead("market").over(w), v)).select("*", *year))
    beyond = panel.join(market, "period").withColumn("__rel", F.when(F.col("liquidity") >= floor, F.col("returns")) - F.col("market"))
    # The next period's excess is in units of its own spread, which is known before it.
    beyond = legs(beyond, "__rel", own(), lambda v, w: F.lead(div(F.col("__rel"), v)).over(w))
    ics = rank_ic(beyond, "past", "nxt", min_names, ("lookback",)).select("*", *year)
    ranks = ics.groupBy(*keys).agg(F.avg("ic").alias("value"), F.stddev_samp("ic").alias("__s"), F.count(F.lit(1)).alias("n"))
    root = F.sqrt(F.col("n").cast("double"))
    made = lambda rows, leg, t: rows.filter(F.col("value").isNotNull()).select(*keys, F.lit(leg).alias("leg"), "value", t.alias("t"), "n")
    return (made(alone, "own", F.col("value") * root).unionByName(made(both, "market", F.col("value") * root))
            .unionByName(made(ranks, "relative", div(F.col("value"), F.col("__s")) * root)))


def histogram(rows: DataFrame, x: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal bin of x held within [lo, hi], the top edge in the last bin."""
    b = F.least(F.greatest(F.floor((F.col(x) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))
    return (rows.filter(F.col(x).isNotNull()).groupBy(*by, b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
