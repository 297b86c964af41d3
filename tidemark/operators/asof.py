"""As-of joins, backward and forward, by key.

Both sides are stacked and the right side's latest row is carried to each left
row inside (key, block of time), so a hot key spreads over its blocks and no
inequality join is planned.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import DAY, micros
from .ordered import last_seen


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              values: dict[str, str | Column], direction: str = "backward", block: int = DAY,
              left_tie: Column | None = None, right_tie: Column | None = None, strict: bool = False) -> DataFrame:
    """left with values of the nearest right row at or before (backward) or at or after (forward) it.

    values maps an output name to a right column or expression, NULL where no
    row qualifies; a NULL key or stamp on either side matches nothing, and left
    rows keep their place all the same. At equal stamps a right row counts unless strict. Ties
    order rows of equal stamps further: where given on both sides, a right row
    qualifies up to the left row's own tie. block is the width in microseconds
    of the time blocks a key is cut into.
    """
    sign = 1 if direction == "backward" else -1
    by = list(by)
    zero = F.lit(0).cast("bigint")
    lt = (left_tie if left_tie is not None else zero).cast("bigint") * sign
    rt = (right_tie if right_tie is not None else zero).cast("bigint") * sign
    both_ties = left_tie is not None and right_tie is not None
    # Without a shared tie scale the side decides: right rows first, or last when strict.
    right_side, left_side = (1, 0) if strict else (0, 1)
    payload = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
    r = right.select(*by, (micros(right, right_on) * sign).alias("__t"), rt.alias("__tie"),
                     F.lit(right_side).alias("__side"), payload.alias("__v")).dropna(subset=[*by, "__t"])
    l = left.select(*by, (micros(left, left_on) * sign).alias("__t"), lt.alias("__tie"),
                    F.lit(left_side).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    rows = r.unionByName(l, allowMissingColumns=True)
    order = ["__t", "__tie", "__side"] if both_ties else ["__t", "__side", "__tie"]
    seen = last_seen(rows, by, order, F.floor(F.col("__t") / F.lit(block)), {"__v": F.col("__v")})
    return (seen.filter(F.col("__l").isNotNull())
            .select("__l.*", *[F.col(f"__v.{n}").alias(n) for n in values]))
