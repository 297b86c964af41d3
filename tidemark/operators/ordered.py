"""Ordered operators that never hold one key's whole history in one task.

A key may hold a third of all rows. Every operator here cuts a key's rows into
blocks of time, works inside (key, block), and carries what crosses a block
through a table with one row per (key, block), which a partial aggregate
builds before any shuffle. Rows move once, on (key, block).
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "__block"


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column,
         sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
         lasts: dict[str, Column] | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """Adds any number of running values per key in order, in one pass: sums, maxima and last non-null values.

    Each covers the rows up to and including its own. before maps a new column
    to one of them, taken over the rows before instead. A sum over nothing is 0,
    a maximum or last value NULL. Rows with a NULL key are one key's, and rows
    whose block is NULL come before all others of theirs. The input is read twice, once for the block
    ends and once for the rows, so an expensive one is stored first
    (session.settle), and values are asked for together rather than in turn.
    """
    keys, sums, maxes, lasts, before = list(keys), sums or {}, maxes or {}, lasts or {}, before or {}
    kinds = {**{n: "sum" for n in sums}, **{n: "max" for n in maxes}, **{n: "last" for n in lasts}}
    rows = df.withColumns({BLOCK: block, **{f"__x_{n}": e for n, e in {**sums, **maxes, **lasts}.items()}})
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    end = {"sum": lambda x: F.sum(x), "max": lambda x: F.max(x),
           "last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), rank))}
    ends = rows.groupBy(*keys, BLOCK).agg(*[end[k](f"__x_{n}").alias(f"__e_{n}") for n, k in kinds.items()])
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)), "max": lambda x, w: F.max(x).over(w),
            "last": lambda x, w: F.last(x, ignorenulls=True).over(w)}
    where = [*keys, BLOCK]
    carried = ends.select(*[F.col(c).alias(f"__at_{c}") for c in where], *[over[k](f"__e_{n}", past).alias(f"__c_{n}") for n, k in kinds.items()])
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: over[k](f"__x_{n}", upto) for n, k in kinds.items()}
    local |= {b: over[kinds[n]](f"__x_{n}", prior) for b, n in before.items()}
    # A NULL key is a key, and a NULL order value a block of its own before all others.
    meet = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in where])
    out = rows.withColumns({f"__l_{n}": e for n, e in local.items()}).join(carried, meet)
    join = {"sum": lambda a, c: F.col(a) + F.col(c), "max": lambda a, c: F.greatest(a, c), "last": lambda a, c: F.coalesce(a, c)}
    made = {**{n: n for n in kinds}, **before}
    return out.select(*[F.col(c) for c in df.columns if c not in made],
                      *[join[kinds[n]](f"__l_{name}", f"__c_{n}").alias(name) for name, n in made.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column,
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            exclusive: bool = False) -> DataFrame:
    """Adds running sums and maxima per key in order; exclusive leaves the row itself out."""
    if not exclusive:
        return scan(df, keys, order, block, sums, maxes)
    names = [*(sums or {}), *(maxes or {})]
    hidden = lambda d: {f"__in_{n}": e for n, e in (d or {}).items()}
    out = scan(df, keys, order, block, hidden(sums), hidden(maxes), before={n: f"__in_{n}" for n in names})
    return out.drop(*[f"__in_{n}" for n in names])


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column,
              values: dict[str, Column]) -> DataFrame:
    """Adds, per key in order, each expression's last non-null value at or before the row."""
    return scan(df, keys, order, block, lasts=values)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Column,
             values: dict[str, Column]) -> DataFrame:
    """Adds each expression's value on the key's row before, NULL values kept as NULL."""
    packed = scan(df, keys, order, block, lasts={"__here": F.struct(*[e.alias(n) for n, e in values.items()])},
                  before={"__prev": "__here"})
    return packed.select(*[F.col(c) for c in df.columns if c not in values],
                         *[F.col(f"__prev.{n}").alias(n) for n in values])


def ordinals(df: DataFrame, at: str, block: Column, name: str = "bar") -> DataFrame:
    """Numbers the distinct values of at from 1 without sorting them all in one task.

    Counts per block give each block its offset; only the block counts, one row
    per block, meet in one place.
    """
    stamps = df.select(at).distinct()
    return running(stamps, [], [at], block, sums={name: F.lit(1).cast("bigint")})
