"""Documents dealt into units of bounded text, and the exchange of hashes between units and ranges of hash values.

An operator that compares short stretches of all texts would move a row for each.
Here a unit sends each hash it holds once, sorted and packed, one row for each
range of hash values: a stretch that fills a third of all text still is one entry
in each unit, and no task gets more of it than there are units. Replies come back
by unit. Texts are dealt once; plans that use the same dealt frame share that
exchange.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .words import texts

#: A range gets what some units hold, so that both sides fit a task and rows between them are not tiny.
UNIT_BYTES, UNITS_IN_RANGE = 8 << 20, 3


@dataclass
class Dealt:
    docs: DataFrame  # doc_id, text, [more], unit
    units: int
    ranges: int


def deal(docs: DataFrame, *extra, unit_bytes: int = UNIT_BYTES) -> Dealt:
    """Rows with their unit: a hash of id and text, so a group of copies spreads out while rows that are equal in both stay together."""
    rows = texts(docs, *extra)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-size // unit_bytes))
    return Dealt(rows.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int")), units, max(1, -(-units // UNITS_IN_RANGE)))


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of so many equal ranges of hash values begins in sorted keys, and the end."""
    edges = [(i << 64) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)
