"""Exact medians of groups that no task could hold.

Counts come before sorting. A group of more than `fits` rows is narrowed, round by
round: one pass counts what lies below and inside its present bounds and sketches
the inside, with partial results in each task; the sketch's values around the
middle rank become the next bounds, which hold it for certain, as the sketch's rank
error is far below one step of the grid. The last pass sends each value inside the bounds
once with its number, and one row for all below and all above. Rows are read once a round and
never moved as they are.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

FITS, GRID, ACCURACY = 1_000_000, 256, 10_000


def _same(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def medians(rows: DataFrame, keys: Sequence[str], x: Column, name: str = "median", fits: int = FITS) -> DataFrame:
    """(keys, name, n, rows): the mean of the two middle values of x per key, null without values; how many values and how many rows there are.

    Null keys are a group, and NaN is the largest value. rows is read again for each round: store an expensive one first (session.settle).
    """
    keys = list(keys)
    v = rows.select(*keys, x.cast("double").alias("__x"))
    sizes = v.groupBy(*keys).agg(F.count("__x").alias("__n"))
    bounds = settle(sizes.filter(F.col("__n") > fits).select(*keys, "__n", F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"), F.col("__n").alias("__inside")))
    large = not bounds.isEmpty()
    while large:
        # Bounds that meet are one value, however often it stands there.
        wide = (F.col("__inside") > fits) & (F.col("__lo").isNull() | (F.col("__lo") < F.col("__hi")))
        if bounds.filter(wide).isEmpty():
            break
        held = _beside(v, bounds.filter(wide), keys)
        inside = F.col("__lo").isNull() | ((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        seen = held.filter(F.col("__x").isNotNull()).groupBy(*keys).agg(
            F.max("__n").alias("__n"), F.count_if(F.col("__x") < F.col("__lo")).alias("__below"), F.count_if(inside).alias("__inside"), F.max("__inside").alias("__was"),
            F.percentile_approx(F.when(inside, F.col("__x")), grid, F.lit(ACCURACY)).alias("__q"))
        place = lambda rank: (rank - F.col("__below")) / F.col("__inside") * GRID
        low = F.greatest(F.floor(place(F.floor((F.col("__n") - 1) / 2) + 1)) - 2, F.lit(0)).cast("int")
        high = F.least(F.ceil(place(F.floor(F.col("__n") / 2) + 1)) + 2, F.lit(GRID)).cast("int")
        # What will be inside, as the sketch has it; a range that does not shrink is one of few values.
        guess = F.ceil(F.col("__inside") * (high - low) / GRID)
        new = seen.select(*keys, "__n", F.get("__q", low).alias("__lo"), F.get("__q", high).alias("__hi"), F.when(guess < F.col("__was"), guess).otherwise(F.lit(0)).cast("bigint").alias("__inside"))
        bounds = settle(bounds.filter(~wide).unionByName(new))
    if large:
        v = _beside(v, bounds, keys, "left")
        side = F.when(F.col("__x").isNull(), 3).when(F.col("__x") < F.col("__lo"), 0).when(F.col("__x") > F.col("__hi"), 2).otherwise(1)
    else:
        side = F.when(F.col("__x").isNull(), 3).otherwise(1)
    v = v.select(*keys, side.alias("__side"), F.when(side == 1, F.col("__x")).alias("__x"))
    counts = v.groupBy(*keys, "__side", "__x").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__side", "__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"__upto": F.sum("__c").over(upto), "n": F.sum(F.when(F.col("__side") < 3, F.col("__c")).otherwise(0)).over(group), "rows": F.sum("__c").over(group)})
    middle = lambda rank: F.max(F.when((F.col("__side") == 1) & (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank), F.col("__x")))
    picked = ranked.groupBy(*keys).agg(middle(F.floor((F.col("n") - 1) / 2) + 1).alias("__a"), middle(F.floor(F.col("n") / 2) + 1).alias("__b"), F.max("n").alias("n"), F.max("rows").alias("rows"))
    whole = F.when((F.col("n") > 0) & (F.col("__a").isNull() | F.col("__b").isNull()), F.raise_error("bounds do not hold the middle").cast("double"))
    return picked.select(*keys, F.coalesce(whole, (F.col("__a") + F.col("__b")) / 2).alias(name), "n", "rows")


def _beside(v: DataFrame, bounds: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    b = bounds.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in bounds.columns if c not in keys])
    return v.join(b, _same(keys), how).drop(*[f"__{k}" for k in keys])
