"""Benchmark decontamination over a distributed positional inverted index.

`index` turns the corpus into blocks of a few MB of text, each with the list of
positions of every term in it: a search engine's document shards, so that no
term, however common, is a group of its own. `search` takes phrases (windows of
test items) in chunks of bounded size to every block. There it starts from the
phrase's rarest term, shifts that term's positions back by its place in the
phrase, and intersects them with the lists of the next rarest terms until no
start is left or all terms agree: an exact phrase match, or with slop a
proximity match, in which each term may stand up to slop words from its place.

Terms are 64-bit hashes of lower-cased words. A null or empty text has no words
and no hits; a test item without words has no window; a test row without an id
still hits words but is not listed. Repeated rows are judged one by one. Empty
tables give empty results or documents without hits; extra columns are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .packed import pack, unpack
from .words import LETTERS, grams, slices, texts

#: Positions left free between documents, so that no match crosses from one into the next.
GAP = 32
WINDOW = 13
CHUNK = 50_000
INDEX = "block string, doc_ids array<bigint>, row_keys array<bigint>, n_words array<int>, terms binary, sizes binary, positions binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in slices(batch, "text", LETTERS):
            h = w.hashes()
            place = (np.arange(len(h)) + np.repeat(np.arange(b - a) * GAP, w.counts)).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, place = h[order], place[order]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(edge, len(h))).astype(np.uint32)
            gaps = np.diff(place, prepend=np.uint32(0))
            gaps[edge] = place[edge]
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), one(batch.column("doc_id").slice(a, b - a).to_pylist(), pa.int64()),
                 one(batch.column("row_key").slice(a, b - a).to_pylist(), pa.int64()), one(w.counts, pa.int32()),
                 *[pa.array([x], pa.binary()) for x in (pack(h[edge], True), pack(sizes), pack(gaps))]],
                names=["block", "doc_ids", "row_keys", "n_words", "terms", "sizes", "positions"])


def index(docs: DataFrame) -> DataFrame:
    """One row a block: its documents and, for each term in it, the sorted positions. Stored in the shared folder."""
    return settle(texts(docs, F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(_index, INDEX))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for a, b, w in slices(batch, "text", LETTERS):
            h = w.hashes()
            rows, terms = [], []
            for d in range(b - a):
                own = h[w.first[d]:w.first[d + 1]]
                n = min(WINDOW, len(own))
                for i in range(len(own) - n + 1 if n else 0):
                    rows.append(a + d)
                    terms.append(own[i:i + n].tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "terms"])


def windows(items: DataFrame) -> DataFrame:
    """Each distinct window of the items, with the items that have it."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_windows, "item_id bigint, terms binary").groupBy("terms").agg(F.collect_set("item_id").alias("items"))


class Block:
    """Position lists of one block by term."""

    def __init__(self, row: dict):
        self.terms = unpack(row["terms"], np.uint64, True)
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.stops = np.cumsum(self.sizes)
        gaps = unpack(row["positions"], np.uint32)
        total = np.cumsum(gaps.astype(np.int64))
        begin = self.stops - self.sizes
        before = np.where(begin > 0, total[begin - 1], 0) if len(begin) else begin
        self.positions = total - np.repeat(before, self.sizes)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's place in this block's dictionary, and whether it is there."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return at, (self.terms[at] == terms) if len(self.terms) else np.zeros(terms.shape, bool)

    def match(self, at: np.ndarray, slop: int = 0) -> np.ndarray:
        """Starts of a phrase, given the places of its terms in the dictionary."""
        order = np.argsort(self.sizes[at], kind="stable")
        lists = lambda k: self.positions[self.stops[at[k]] - self.sizes[at[k]]:self.stops[at[k]]]
        starts = lists(order[0]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            own = lists(k)
            near = np.minimum(np.searchsorted(own, starts + k - slop), len(own) - 1)
            starts = starts[np.abs(own[near] - starts - k) <= slop]
        return starts


def merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # Documents apart by more than any position, so that one running maximum serves all.
    far = int(stop.max(initial=0)) + 2
    reach = np.maximum.accumulate(doc * far + stop) if len(doc) else doc
    new = np.ones(len(doc), bool)
    new[1:] = (doc * far + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[:len(first)] - 1
    return doc[first], start[first], reach[last] - doc[first] * far if len(first) else stop[:0]


def _searcher(phrases: list[np.ndarray], items: list[list[int]], slop: int):
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        by_size.setdefault(len(p), []).append(i)
    tables = {n: (np.array(ids), np.stack([phrases[i] for i in ids])) for n, ids in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, hits = Block(row), []
                for n, (ids, terms) in tables.items():
                    at, there = block.find(terms)
                    for k in np.flatnonzero(there.all(1)):
                        starts = block.match(at[k], slop)
                        if len(starts):
                            hits.append((starts, np.full(len(starts), n), np.full(len(starts), ids[k])))
                if not hits:
                    continue
                start, size, phrase = map(np.concatenate, zip(*hits))
                counts = np.array(row["n_words"], np.int64)
                base = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
                doc = np.searchsorted(base, start + (slop if slop else 0), "right") - 1
                begin = np.clip(start - slop - base[doc], 0, None)
                end = np.minimum(start + size + slop - base[doc], counts[doc])
                pairs = np.unique(np.stack([doc, phrase]), axis=1)
                found: dict[int, set] = {}
                for d, p in pairs.T.tolist():
                    found.setdefault(d, set()).update(items[p])
                doc, begin, end = merge(doc, begin, end)
                docs, edge = np.unique(doc, return_index=True)
                edge = np.append(edge, len(doc)).astype(np.int32)
                spans = pa.ListArray.from_arrays(edge, pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "stop"]))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(docs)), pa.array(docs.astype(np.int32)), spans,
                                                  pa.array([sorted(found[d]) for d in docs.tolist()], pa.list_(pa.int64()))],
                                                 names=["block", "place", "spans", "items"])
    return run


def search(indexed: DataFrame, phrases: DataFrame, slop: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(block, place, spans, items) of documents with a match: merged word spans, and items with a matching phrase.

    phrases: (terms, items) as from `windows`. They go to every block in chunks
    of about so many, so what one task holds does not grow with the test set; a
    document matched in two chunks has two rows. slop must be under GAP.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    phrases = settle(phrases)
    n = max(1, -(-phrases.count() // chunk))
    found = None
    for k in range(n):
        rows = phrases.where(F.pmod(F.xxhash64("terms"), F.lit(n)) == k).toPandas()
        run = _searcher([np.frombuffer(t, np.uint64) for t in rows["terms"]], [[int(i) for i in x] for x in rows["items"]], slop)
        part = indexed.select("block", "n_words", "terms", "sizes", "positions").mapInArrow(
            run, "block string, place int, spans array<struct<start:int,stop:int>>, items array<bigint>")
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame, share: float = 0.05) -> DataFrame:
    """Per document: doc_id, row_key, n_words, n_hit, spans of hit words, the items met, contaminated (n_hit > 0 and n_hit >= share * n_words)."""
    indexed = index(docs)
    hits = search(indexed, windows(items)).groupBy("block", "place").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
                                                                        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = indexed.select("block", F.posexplode(F.arrays_zip("doc_ids", "row_keys", "n_words")).alias("place", "d"))
    rows = rows.select("block", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.row_keys").alias("row_key"), F.col("d.n_words").cast("bigint").alias("n_words"))
    # Spans of two chunks may overlap; each adds what lies beyond the furthest stop so far.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n")),
                          lambda s, x: F.struct(F.greatest(s.to, x.stop).alias("to"),
                                                (s.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, s.to))).alias("n")), lambda s: s.n)
    out = rows.join(hits, ["block", "place"], "left").withColumn("n_hit", F.coalesce(covered, F.lit(0).cast("bigint")))
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / share) >= F.col("n_words"))).drop("block", "place")
