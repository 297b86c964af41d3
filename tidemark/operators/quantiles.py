"""Exact quantiles of the rows before, where every row would otherwise sort its whole frame.

A key's rows pass through its task in order, and an ordered multiset takes each value in and lets go of
those that leave the frame, so a row costs about the logarithm of its frame and not its length.
"""
from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

LOAD = 512  # values a part of the multiset holds before it is halved, at twice this many
SPANS = 4   # spans of time that one block of a key's rows covers


class Multiset:
    """Floats in order: add, drop and rank in parts of bounded length."""

    def __init__(self):
        self.parts, self.tops, self.n = [], [], 0

    def add(self, v: float) -> None:
        self.n += 1
        if not self.parts:
            self.parts, self.tops = [[v]], [v]
            return
        i = min(bisect_left(self.tops, v), len(self.parts) - 1)
        part = self.parts[i]
        insort(part, v)
        self.tops[i] = part[-1]
        if len(part) > 2 * LOAD:
            self.parts[i:i + 1] = part[:LOAD], part[LOAD:]
            self.tops[i:i + 1] = part[LOAD - 1], part[-1]

    def drop(self, v: float) -> None:
        """Takes out one v, which must be there."""
        i = bisect_left(self.tops, v)
        part = self.parts[i]
        del part[bisect_left(part, v)]
        self.n -= 1
        if part:
            self.tops[i] = part[-1]
        else:
            del self.parts[i], self.tops[i]

    def rank(self, k: int) -> float:
        for part in self.parts:
            if k < len(part):
                return part[k]
            k -= len(part)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        """Linear between the two nearest ranks."""
        place = (self.n - 1) * q
        lo = int(place)
        a = self.rank(lo)
        if lo == place:
            return a
        b = self.rank(lo + 1)
        return a if a == b else (lo + 1 - place) * a + (place - lo) * b


def trailing(df: DataFrame, keys: Sequence[str], order: Column, x: str | Column, probs: Mapping[str, float], least: int = 1,
             span: int | None = None, inclusive: bool = True) -> DataFrame:
    """Adds a column per entry of probs: that quantile of x over the key's rows up to the row, NULL below least values.

    order is a whole number. span keeps the rows with order in (o - span, o]; without it all earlier ones count.
    inclusive takes in the row and those of the same order; otherwise only smaller orders count. NULL and NaN are no
    values; a row without an order gets NULL and counts for no other; NULL keys are a key.

    With a span, a key is cut into blocks of time, and rows that reach into the next block's frames are sent to both, so a key with a
    third of all rows spreads over its blocks and a task holds one frame. Without one, a key's past is in one task:
    for period data, whose length the calendar bounds. Rows move once.
    """
    keys, names = list(keys), list(probs)
    rows = df.withColumns({"__o": order.cast("bigint"), "__x": (F.col(x) if isinstance(x, str) else x).cast("double")})
    if span is not None:
        width = SPANS * span
        own = F.floor(F.col("__o") / F.lit(width))
        # A row of the last span before a block's end is in frames of the next.
        reaches = F.col("__o") >= (own + 1) * width - (span - 1)
        rows = rows.withColumn("__b", F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("__guest", F.coalesce(F.col("__b") > own, F.lit(False)))
    else:
        rows = rows.withColumns({"__b": F.lit(0), "__guest": F.lit(False)})
    w = Window.partitionBy(*keys, "__b").orderBy("__o")
    marked = rows.withColumns({"__first": F.row_number().over(w) == 1, "__ends": F.lead(F.lit(True)).over(w).isNull() | ~F.lead("__o").over(w).eqNullSafe(F.col("__o"))})
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return marked.mapInArrow(_follow(df.columns, names, [probs[n] for n in names], max(least, 1), span, inclusive), schema)


def _follow(columns: Sequence[str], names: Sequence[str], probs: Sequence[float], least: int, span: int | None, inclusive: bool):
    def follow(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        held, inside = Multiset(), deque()
        waiting, peers = None, 0  # rows of one order whose last one is still to come

        def reads():
            return [None] * len(probs) if held.n < least else [held.quantile(q) for q in probs]

        for batch in batches:
            marks = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__o", "__x", "__first", "__ends")}
            answers = []
            for o, v, first, ends in zip(marks["__o"], marks["__x"], marks["__first"], marks["__ends"]):
                if first:
                    held, inside = Multiset(), deque()
                if o is not None and v is not None and v == v:
                    inside.append((o, v))
                    if inclusive:
                        held.add(v)
                peers += 1
                if not ends:
                    continue
                if span is not None and o is not None:
                    while inside and inside[0][0] <= o - span:
                        held.drop(inside.popleft()[1])
                got = reads() if o is not None else [None] * len(probs)
                answers.extend([got] * peers)
                if not inclusive:
                    for p, new in reversed(inside):
                        if p != o:
                            break
                        held.add(new)
                peers = 0
            whole = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            done = whole.slice(0, len(answers))
            waiting = whole.slice(len(answers)) if len(answers) < whole.num_rows else None
            if not answers:
                continue
            done_columns = {c: done.column(c) for c in columns}
            out = pa.table({**done_columns, **{n: pa.array([a[k] for a in answers], pa.float64()) for k, n in enumerate(names)}})
            yield from out.filter(pc.invert(done.column("__guest"))).to_batches()
    return follow
