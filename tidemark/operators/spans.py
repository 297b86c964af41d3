"""Interval joins: points of a key beside the spans of that key which hold them.

Spans and points meet by (key, block of time), an equality that spreads a hot key over its
blocks; a span stands in each block it touches. What comes out are held points alone, never
points times spans of a key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import DAY, micros
from .ordered import previous


def until_next(rows: DataFrame, keys: Sequence[str], at: str, block: int = 32 * DAY, name: str = "until") -> DataFrame:
    """Adds the stamp of the key's next row, null for its last. Stamps of a key differ."""
    back = -micros(rows, at)
    return previous(rows, list(keys), [back], F.floor(back / F.lit(block)), {name: F.col(at)})


def during(spans: DataFrame, points: DataFrame, by: Sequence[str], at: str, since: str = "since", until: str = "until",
           opening: bool | Column = True, width: int = 32 * DAY) -> DataFrame:
    """Points with the columns of each span of their key that they fall into.

    since <= at < until, or since < at <= until where opening, which may be a column of
    points, is false. A null until is open; a null since, key or stamp meets nothing. points are
    read twice (session.settle). width: of the blocks, in microseconds; about as long as spans
    are, so that few stand in many blocks.
    """
    by = list(by)
    # Spans end where points do: one number.
    top = points.agg(F.max(micros(points, at))).first()[0]
    w, end = F.lit(width), F.least(F.coalesce(micros(spans, until), F.lit(top)), F.lit(top))
    s = spans.select("*", micros(spans, since).alias("__since"), micros(spans, until).alias("__until")).filter(F.col("__since") <= F.lit(top))
    s = s.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__since") / w), F.floor(F.greatest(end, F.col("__since")) / w))))
    p = points.withColumn("__at", micros(points, at)).withColumn("__block", F.floor(F.col("__at") / w))
    s = s.drop(since, until) if at not in (since, until) else s
    first, at, until = F.lit(opening) if isinstance(opening, bool) else opening, F.col("__at"), F.col("__until")
    p = p.withColumn("__first", first)
    inside = (F.col("__since") <= at) & (F.coalesce(until, at) >= at)
    edge = F.when(F.col("__first"), until.isNull() | (at < until)).otherwise(F.col("__since") < at)
    return p.join(s, [*by, "__block"]).filter(inside & edge).drop("__block", "__at", "__since", "__until", "__first")
