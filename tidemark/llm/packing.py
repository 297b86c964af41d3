"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Texts are tokenized once; a document over the capacity is cut into full pieces,
which fill a sequence each, and a last piece. What is left is dealt at random
into pools of about POOL pieces, however many there are. Each pool is evolved on
several islands. A chromosome is a grouping of the pool's pieces into sequences:
crossover injects well-filled whole sequences of one parent into another,
dissolves those of the other that hold the same pieces, and best-fits the
displaced pieces. After each epoch every island's elite migrates to the next, and
a pool stops at the bound of its total length. Pieces in sequences that stay
badly filled, a few for each pool, are gathered and packed once more.

A null text is empty: one piece of only the end id. Repeated rows are documents
of their own. An empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .encode import shared
from .words import column, mix, parts, texts

CAPACITY, END = 4096, 1
POOL, ISLANDS, PARENTS, CHILDREN, EPOCHS, LOOSE = 20_000, 2, 4, 6, 2, 0.97
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"


def _cutter(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(path)
        for batch in batches:
            buf, offsets = column(batch.column("text"))
            for a, b in parts(offsets):
                ids, counts = encoder.encode(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
                counts = counts + 1
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                crc = np.fromiter((zlib.crc32(ids[i:i + n]) for i, n in zip(at, length)), np.int64, len(doc))
                deal = mix(crc.astype(np.uint64) + mix(np.arange(len(doc), dtype=np.uint64) + np.uint64(a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                                                  *[pa.array(x) for x in (start, length, crc, deal.view(np.int64))]],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document with the crc32 of their ids. Stored in the shared folder."""
    return settle(texts(docs).mapInArrow(_cutter(path, capacity, end), PIECES))


class Rooms:
    """Sequences by the room they have left; the least room that is enough is found in one step."""

    def __init__(self, room: np.ndarray, capacity: int):
        self.capacity, self.room = capacity, room.tolist()
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b, r in enumerate(self.room):
            self.by_room[r].append(b)
            self.mask |= 1 << r

    def put(self, length: int) -> int:
        enough = self.mask >> length
        if enough:
            r = length + (enough & -enough).bit_length() - 1
            b = self.by_room[r].pop()
            if not self.by_room[r]:
                self.mask ^= 1 << r
        else:
            b, r = len(self.room), self.capacity
            self.room.append(r)
        self.room[b] = left = r - length
        self.by_room[left].append(b)
        self.mask |= 1 << left
        return b


def best_fit(groups: np.ndarray, lengths: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """groups with its loose pieces put, in the order given, where they fit best. Group numbers become dense."""
    fixed = np.ones(len(groups), bool)
    fixed[loose] = False
    out = groups.copy()
    names, out[fixed] = np.unique(groups[fixed], return_inverse=True)
    rooms = Rooms((capacity - np.bincount(out[fixed], lengths[fixed], len(names))).astype(np.int64), capacity)
    out[loose] = [rooms.put(n) for n in lengths[loose].tolist()]
    return out


def cross(to: np.ndarray, of: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two groupings: some of the well-filled groups of one are injected whole into the other."""
    fill = np.bincount(of, lengths)
    full = np.argsort(-fill, kind="stable")[:max(1, len(fill) // 2)]
    injected = np.zeros(len(fill), bool)
    injected[rng.choice(full, max(1, len(full) // 4), replace=False)] = True
    taken = injected[of]
    hit = np.zeros(int(to.max()) + 1, bool)
    hit[to[taken]] = True
    own = np.bincount(to, lengths)
    hit[np.argsort(own, kind="stable")[:max(1, len(own) // 50)]] = True  # the worst-filled go too
    child = np.where(taken, of + len(hit), to)
    displaced = np.flatnonzero(hit[to] & ~taken)
    return best_fit(child, lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], capacity)


def fitness(groups: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Fewer sequences, then fuller ones; less is better."""
    fill = np.bincount(groups, lengths).astype(float)
    return len(fill), -float((fill ** 2).sum())


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """One epoch on one island: the best PARENTS, best first. An empty population begins with best-fit of longest first and of noisy orders."""
    rng, bound = np.random.default_rng(seed), -(-int(lengths.sum()) // capacity)
    k = 0
    while len(population) < PARENTS:
        noise = rng.random(len(lengths)) * (0.15 * k + 0.1 * (seed % ISLANDS)) + 1
        order = np.argsort(-lengths * noise, kind="stable")
        population.append(best_fit(np.zeros(len(lengths), np.int64), lengths, order, capacity))
        k += 1
        if int(population[-1].max()) + 1 <= bound:
            return population
    rank = lambda p: sorted(p, key=lambda g: fitness(g, lengths))
    population = rank(population)
    for _ in range(CHILDREN):
        if int(population[0].max()) + 1 <= bound:
            break
        # Tournaments of two.
        a, b = (min(rng.choice(len(population), 2, replace=False)) for _ in range(2))
        b = b if b != a else (a + 1) % len(population)
        population = rank([*population, cross(population[a], population[b], lengths, capacity, rng)])[:PARENTS]
    return population[:PARENTS]


ISLAND = "pool int, island int, lengths binary, groups binary, elite binary, sequences int, bound int"


def _islands(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int64)
                old = [np.frombuffer(row[c], np.int32).reshape(-1, len(lengths)).astype(np.int64) for c in ("groups", "elite") if row.get(c)]
                new = evolve(lengths, [g for x in old for g in x], capacity, (row["pool"] * ISLANDS + row["island"]) * 97 + epoch * ISLANDS + row["island"])
                best = new[0]
                yield pa.RecordBatch.from_pylist([{"pool": row["pool"], "island": row["island"], "lengths": row["lengths"],
                                                   "groups": np.stack(new).astype(np.int32).tobytes(), "elite": best.astype(np.int32).tobytes(),
                                                   "sequences": int(best.max()) + 1, "bound": -(-int(lengths.sum()) // capacity)}],
                                                 pa.schema([("pool", pa.int32()), ("island", pa.int32()), ("lengths", pa.binary()), ("groups", pa.binary()),
                                                            ("elite", pa.binary()), ("sequences", pa.int32()), ("bound", pa.int32())]))
    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(x, np.int64).tobytes() for x in batch.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pool"), batch.column("island"), pa.array(data, pa.binary())], names=["pool", "island", "lengths"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pool's pieces with their sequence, offset and its fill."""
    for batch in batches:
        for r in range(batch.num_rows):
            members = batch.column("members")[r].values
            lengths = members.field("length").to_numpy()
            group = np.frombuffer(batch.column("elite")[r].as_py(), np.int32).astype(np.int64)
            order = np.argsort(group, kind="stable")
            n, g = lengths[order], group[order]
            before = np.cumsum(n) - n
            first = np.searchsorted(g, np.arange(int(g.max()) + 1))
            fill = np.bincount(g, n).astype(np.int64)
            rows = members.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [rows.field("doc_id"), rows.field("piece"), rows.field("start"), rows.field("length"), rows.field("ids_crc32"), rows.field("deal"),
                 pa.array((np.int64(batch.column("pool")[r].as_py()) << 32) + g), pa.array(before - before[first][g]), pa.array(fill[g])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "deal", "sequence_id", "offset", "fill"])


def _packed(rows: DataFrame, capacity: int, pool: int) -> DataFrame:
    n = max(1, -(-rows.count() // pool))
    dealt = rows.withColumn("pool", F.pmod("deal", F.lit(n)).cast("int"))
    # A pool is bounded by how it is dealt: at random, whatever the documents.
    pools = settle(dealt.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("deal", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("members")))
    each = pools.select("pool", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("members.length").alias("lengths"))
    spread = each.repartition("pool", "island").mapInArrow(_lengths, "pool int, island int, lengths binary")
    state = settle(spread.mapInArrow(_islands(capacity, 0), ISLAND))
    for epoch in range(1, EPOCHS + 1):
        if state.groupBy("pool").agg(F.min("sequences").alias("n"), F.first("bound").alias("bound")).where("n > bound").isEmpty():
            break
        elites = state.select("pool", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "elite")
        moved = state.drop("elite").join(elites, ["pool", "island"]).select("pool", "island", "lengths", "groups", "elite")
        state = settle(moved.mapInArrow(_islands(capacity, epoch), ISLAND))
    best = state.groupBy("pool").agg(F.min_by("elite", F.struct("sequences", "island")).alias("elite"))
    placed = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint, sequence_id bigint, offset bigint, fill bigint"
    return settle(pools.join(best, "pool").mapInArrow(_placed, placed))


def pack(cut: DataFrame, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """Pieces with sequence_id and offset: sequences are gapless from 0 and hold at most capacity ids."""
    full = cut.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() * 4 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    first = _packed(cut.where(F.col("length") < capacity), capacity, pool)
    again = _packed(first.where(F.col("fill") < int(LOOSE * capacity)).select(*cut.columns), capacity, pool)
    kept = first.where(F.col("fill") >= int(LOOSE * capacity)).drop("fill").withColumn("sequence_id", F.col("sequence_id") * 4 + 2)
    return full.unionByName(kept).unionByName(again.drop("fill").withColumn("sequence_id", F.col("sequence_id") * 4 + 3)).drop("deal")
