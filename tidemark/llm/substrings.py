"""Removal of passages that occur more than once, by fixed-block anchors.

Each text is cut into non-overlapping blocks of (window + 1) // 2 words from its
start; their hashes are the index. A repeated window of words covers a whole
block of either place where it stands, so probing the index with the rolling
windows of block length of all texts finds an anchor inside every repeat.
Anchors are then extended: each window of full length around an anchor is looked
up by a 128-bit hash among the windows around anchors everywhere, and those that
start in another place as well are repeats; runs of them are the maximal exact
repeats. All windows are judged on the input, and every copy is removed.

Texts are dealt into units (see `units`), which send each hash once with whether
they hold it twice, so a passage in a third of all texts is one entry a unit and
no pairs of copies are ever formed.

A null or empty text has no words. Repeated rows are copies of each other, as
are texts under one id. Texts shorter than the window lose nothing. Extra
columns are ignored, or kept by `remove`.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .packed import pack, unpack
from .units import cuts, deal
from .words import PLAIN, WORD_BASE, column, grams, mix, parts, runs, split

WINDOW = 35
ONCE, TWICE, BLOCK = 0, 1, 2
SENT = "unit int, range int, keys binary, checks binary, flags binary"
FOUND = "unit int, keys binary"


def sliced(text: pa.ChunkedArray) -> Iterator[tuple]:
    buf, offsets = column(text)
    for a, b in parts(offsets):
        yield a, b, split(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], PLAIN)


def second(h: np.ndarray, n: int) -> np.ndarray:
    """Another hash of each n consecutive words, independent of `grams`."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return runs(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), at, at + n, WORD_BASE)


def _probes(ranges: int, size: int):
    """All rolling windows of block length of a unit, each once: which of them it holds twice and which are blocks."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, blocks = [], []
        for _, _, w in sliced(table["text"]):
            h, left = w.hashes(), w.left()
            whole = left[:max(len(h) - size + 1, 0)] >= size
            place = np.arange(len(whole)) - np.repeat(w.first[:-1], w.counts)[:len(whole)]
            keys.append(grams(h, size)[whole])
            blocks.append((place % size == 0)[whole])
        values, block = np.concatenate(keys), np.concatenate(blocks)
        found, place, n = np.unique(values, return_inverse=True, return_counts=True)
        flags = np.where(n > 1, TWICE, ONCE).astype(np.uint8)
        flags[place[block]] |= BLOCK
        return _sent(key[0].as_py(), ranges, found, None, flags)
    return run


def _sent(unit: int, ranges: int, keys: np.ndarray, checks: np.ndarray | None, flags: np.ndarray) -> pa.Table:
    at = cuts(keys, ranges)
    some = [r for r in range(ranges) if at[r + 1] > at[r]]
    cut = lambda x, sort=False: pa.array([pack(x[at[r]:at[r + 1]], sort) if x is not None else None for r in some], pa.binary())
    return pa.table([pa.array([unit] * len(some), pa.int32()), pa.array(some, pa.int32()), cut(keys, True), cut(checks), cut(flags)],
                    names=["unit", "range", "keys", "checks", "flags"])


def _matched(key: tuple, table: pa.Table) -> pa.Table:
    """Hashes of a range that stand in two places, with a block among them if blocks were sent, for each unit that holds them."""
    units, checked = table["unit"].to_pylist(), table["checks"].null_count < len(table)
    flags = [unpack(f.as_py(), np.uint8) for f in table["flags"]]
    edge, flags = np.cumsum([0, *map(len, flags)]), np.concatenate(flags)
    keys = _flat(table["keys"], edge, True)
    if checked:
        hit = agreed(keys, _flat(table["checks"], edge), flags)
        own = (keys[a:b][hit[a:b]] for a, b in zip(edge, edge[1:]))
    else:
        hits = anchored(keys, flags)
        own = (keys[a:b][among(keys[a:b], hits)] for a, b in zip(edge, edge[1:]))
    rows = [(u, pack(k, True)) for u, k in zip(units, own) if len(k)]
    return pa.table([pa.array([u for u, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], names=["unit", "keys"])


def _flat(packed: pa.ChunkedArray, edge: np.ndarray, differences: bool = False) -> np.ndarray:
    """The hashes of all rows, unpacked row by row into one array."""
    out = np.empty(edge[-1], np.uint64)
    for row, a, b in zip(packed, edge, edge[1:]):
        out[a:b] = unpack(row.as_py(), np.uint64, differences)
    return out


def anchored(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Keys that stand in two places or are flagged TWICE, and are flagged BLOCK somewhere; each once, in order."""
    every = np.sort(keys)
    found = every[1:][every[1:] == every[:-1]]
    del every
    found = np.unique(np.concatenate([found, keys[(flags & TWICE) > 0]]))
    return found[among(found, np.sort(keys[(flags & BLOCK) > 0]))]


def agreed(keys: np.ndarray, checks: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which places hold a pair of both hashes that stands in another place too or is flagged TWICE."""
    order = np.lexsort((checks, keys))
    same = np.ones(max(len(order) - 1, 0), bool)
    # One hash at a time is put in order.
    for hashes in (keys, checks):
        ranked = hashes[order]
        same &= ranked[1:] == ranked[:-1]
        del ranked
    hit = (flags & TWICE) > 0
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def _told(found: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(k, np.uint64, True) for k in found["keys"].to_pylist()]]))


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def _extended(ranges: int, size: int, window: int):
    """Windows of full length that hold an anchor, each once with whether the unit holds it twice."""
    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        keys, checks, anchors = [], [], _told(found)
        for _, _, w in sliced(table["text"]) if len(anchors) else ():
            h, left = w.hashes(), w.left()
            starts = np.flatnonzero(left[:max(len(h) - window + 1, 0)] >= window)
            if not len(starts):
                continue
            anchor = np.zeros(len(h) + 1, np.int64)
            hit = among(grams(h, size), anchors)
            hit &= left[:len(hit)] >= size
            anchor[1:len(hit) + 1] = hit
            total = np.cumsum(anchor)
            starts = starts[total[np.minimum(starts + window - size + 1, len(h))] > total[starts]]
            keys.append(grams(h, window)[starts])
            checks.append(second(h, window)[starts])
        if not keys:
            return _sent(key[0].as_py(), 0, np.zeros(0, np.uint64), None, np.zeros(0, np.uint8))
        keys, checks = np.concatenate(keys), np.concatenate(checks)
        order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        n = np.diff(np.append(np.flatnonzero(new), len(keys)))
        return _sent(key[0].as_py(), ranges, keys[new], checks[new], np.where(n > 1, TWICE, ONCE).astype(np.uint8))
    return run


def covered(w, h: np.ndarray, repeats: np.ndarray, window: int) -> np.ndarray:
    """Words inside a repeated window."""
    starts = among(grams(h, window), repeats) & (w.left()[:max(len(h) - window + 1, 0)] >= window)
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:len(starts)] += starts
    edge[window:window + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def _kept(window: int):
    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        repeats, rows = _told(found), []
        for _, _, w in sliced(table["text"]):
            gone = covered(w, w.hashes(), repeats, window) if len(repeats) else np.zeros(len(w.starts), bool)
            n = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            raw = w.buf.tobytes()
            for d, (a, b) in enumerate(zip(w.first, w.first[1:])):
                words = raw[w.edges[d]:w.edges[d + 1]].split()
                if n[d]:
                    words = [x for x, g in zip(words, gone[a:b]) if not g]
                rows.append((int(b - a), int(n[d]), b" ".join(words)))
        kept = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([table["doc_id"], table["rest"], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), kept,
                                     table["text"]], names=["doc_id", "rest", "n_words", "n_removed", "kept_text", "text"])
    return run


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, rest (its other columns), n_words, n_removed, kept_text (the kept words joined by one space) and text as it was."""
    size = (window + 1) // 2
    others = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    dealt = deal(docs, F.struct(*others).alias("rest"))
    docs, ranges = dealt.docs, dealt.ranges
    unit = lambda: docs.groupBy("unit")
    probes = unit().applyInArrow(_probes(ranges, size), SENT)
    anchors = probes.groupBy("range").applyInArrow(_matched, FOUND)
    windows = unit().cogroup(anchors.groupBy("unit")).applyInArrow(_extended(ranges, size, window), SENT)
    found = windows.groupBy("range").applyInArrow(_matched, FOUND)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), docs.schema["rest"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")],
                           *[T.StructField(c, T.StringType()) for c in ("kept_text", "text")]])
    return unit().cogroup(found.groupBy("unit")).applyInArrow(_kept(window), schema)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the words of repeats: texts that lose some become their kept words joined by one space, others stay as they are, and documents
    of which nothing is left go."""
    left = repeats(docs, window).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return left.select(*[text.alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
