"""Whole texts as arrays inside tasks: words, their 64-bit hashes and hashes of runs of words.

Everything works on slices of an Arrow batch, half a MB of text or one longer
text, straight on Arrow's bytes. A null text has no words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE = 1 << 19
#: Odd, so that they have inverses modulo 2**64; 5 modulo 8, so that their powers differ early.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95 | 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo 2**64, and their inverses."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, SLICE + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b & 0xFFFFFFFFFFFFFFFF, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = tuple(both)
    p, inverse = _powers[base]
    return p[:n], inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """A hash of each values[start:stop], from differences of one running sum."""
    p, inverse = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=total[1:])
    return mix((total[stops] - total[starts]) * inverse[starts])


def alphabet(lower: bool, word: bytes | None = None) -> np.ndarray:
    """For each byte its value in a word, or 0 between words. word: the bytes of words; all but white space if None."""
    table = np.arange(1, 257, dtype=np.uint64)
    if lower:
        table[65:91] += np.uint64(32)
    keep = np.zeros(256, bool)
    keep[list(word) if word is not None else [b for b in range(256) if b not in b"\t\n\v\f\r "]] = True
    table[~keep] = 0
    return table


#: `[^\x20\x09-\x0D]+`, as it is or with A-Z lower-cased.
PLAIN, LOWER = alphabet(False), alphabet(True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
LETTERS = alphabet(True, bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def column(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the place of each row's first byte, one more than rows."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
        a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    kind = np.int64 if wide else np.int32
    _, places, data = a.buffers()
    offsets = np.frombuffer(places, kind)[a.offset:a.offset + len(a) + 1].astype(np.int64) if places is not None and len(places) else np.zeros(len(a) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(stop, rows)
        at = min(stop, rows)


@dataclass
class Words:
    """Words of consecutive texts: text d is buf[edges[d]:edges[d + 1]] and first[d] the place
    of its first word; starts and stops are bytes of buf."""
    buf: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray
    table: np.ndarray
    edges: np.ndarray

    def hashes(self) -> np.ndarray:
        return runs(self.table[self.buf], self.starts, self.stops, BYTE_BASE)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, the words from it to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def split(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    inside = (table != 0)[buf]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    end[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    return Words(buf, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets), table, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, whatever texts they are from; see Words.left."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return runs(h, at, at + n, WORD_BASE)


def slices(batch, name: str, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """The rows and the words of a batch, slice by slice."""
    buf, offsets = column(batch.column(name))
    for a, b in parts(offsets):
        yield a, b, split(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], table)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator reads, so the scan reads no others."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def rows_of(batch: pa.RecordBatch, a: int, b: int, **more) -> pa.RecordBatch:
    """doc_id of rows a to b beside new columns."""
    return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[x if isinstance(x, pa.Array) else pa.array(x) for x in more.values()]],
                                      names=["doc_id", *more])
