"""Near-duplicates by a chosen-path set similarity join, down to connected components.

A document's set is its distinct 3-word shingles, as 64-bit hashes. Equal sets
are one class. Each class has POSITIONS minwise tokens. In each of TREES
independent trees a node picks BRANCHES token positions and sends every class it
holds to the children named by its tokens there; documents of similarity s stay
together in a child with probability 1 - (1 - s)**BRANCHES at each step. A node of
at most LIMIT classes is compared exhaustively on sketches of all positions, a
larger one branches again; nodes still large at DEPTH are compared exhaustively
in pairs of blocks. With 4 trees and 2 branches, a pair at the threshold of 0.85
that meets in leaves at the first step is missed with probability 0.15**8 = 3e-7,
and at the fixed point of any depth with 0.031**4 = 9e-7.

The sketch only has to group what may be similar: KEEP of 64 positions equal, which
a linked pair misses with probability under 1e-6. Each comparison returns a star
of every group it found, not its pairs, and components of those stars are the
candidate clusters. Every cluster is then compared exhaustively on full sets, in
one task if it is small and in pairs of blocks if not, each a breadth-first search
that never compares two documents already joined: links are exact, and a group of
copies costs about its size. Components of the exact links are the result.

A null text or one without words has an empty set and links with nothing; fewer
words than three are one shingle. Repeated rows are copies. A null doc_id is its
own least id only where no other member has one. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .components import components
from .words import LOWER, WORD_BASE, grams, mix, runs, slices, texts

POSITIONS, TOKENS, TREES, BRANCHES, DEPTH = 64, 24, 4, 2, 4
LIMIT, KEEP, ELEMENTS = 2000, 38, 1_500_000
_draw = np.random.default_rng(20240229)
XORS, FACTORS = _draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64), _draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, n: int = 3) -> np.ndarray:
    """The sorted distinct shingles of one text's word hashes."""
    if len(h) >= n:
        return np.unique(grams(h, n))
    return runs(h, np.array([0]), np.array([len(h)]), WORD_BASE) + np.uint64(len(h)) if len(h) else np.zeros(0, np.uint64)


def sets(h: np.ndarray, first: np.ndarray, n: int = 3) -> Iterator[np.ndarray]:
    """The same for consecutive texts."""
    g = grams(h, n)
    for a, b in zip(first, first[1:]):
        yield np.unique(g[a:b - n + 1]) if b - a >= n else shingles(h[a:b], n)


def name(s: np.ndarray) -> bytes:
    """128 bits for a set, so that equal sets are one class."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ XORS[0]).sum(dtype=np.uint64)]).astype(">u8").tobytes()


def minwise(s: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        np.minimum(least, ((s[a:a + 4096, None] ^ XORS) * FACTORS).min(0), out=least)
    return mix(least)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in slices(batch, "text", LOWER):
            rows = []
            for s in sets(w.hashes(), w.first):
                m = minwise(s) if len(s) else None
                rows.append((len(s), name(s) if len(s) else None, (m[:TOKENS] >> np.uint64(32)).astype(np.uint32).tobytes() if len(s) else None,
                             m.astype(np.uint8).tobytes() if len(s) else None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a),
                                              *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))]],
                                             names=["doc_id", "row_key", "n_shingles", "class", "tokens", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per document its class (null for an empty set), minwise tokens and sketch. Stored in the shared folder."""
    return settle(texts(docs, F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(
        _signed, "doc_id bigint, row_key bigint, n_shingles bigint, class binary, tokens binary, sketch binary"))


NODES = "node bigint, class binary, tokens binary, sketch binary"


def _branch(root: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            t = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(rows, TOKENS).astype(np.uint64)
            if root:
                # Trees use positions of their own at the root.
                ways = [(np.full(rows, k * BRANCHES + j), np.full(rows, k, np.uint64)) for k in range(TREES) for j in range(BRANCHES)]
            else:
                parent = batch.column("node").to_numpy().view(np.uint64)
                start = mix(parent) % np.uint64(TOKENS)
                step = np.uint64(1) + np.uint64(2) * (mix(parent ^ XORS[1]) % np.uint64(3))
                ways = [(((start + step * np.uint64(j)) % np.uint64(TOKENS)).astype(np.int64), parent) for j in range(BRANCHES)]
            for position, parent in ways:
                child = mix(mix(parent + XORS[2]) + np.uint64(WORD_BASE) * (position.astype(np.uint64) << np.uint64(32) | t[np.arange(rows), position]))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *[batch.column(c) for c in ("class", "tokens", "sketch")]],
                                                 names=["node", "class", "tokens", "sketch"])
    return run


def search(n: int, neighbours: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """A root for each of n items, by breadth-first search. neighbours(x, rest): which of rest are linked with x; linked items are never asked about again."""
    root, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        seed = queue[0]
        root[seed] = seed
        while queue and len(rest):
            linked = neighbours(queue.pop(), rest)
            new = rest[linked]
            if len(new):
                root[new] = seed
                queue += new.tolist()
                rest = rest[~linked]
    return root


def by_sketch(sketch: np.ndarray) -> np.ndarray:
    return search(len(sketch), lambda x, rest: (sketch[rest] == sketch[x]).sum(1) >= KEEP)


def by_set(members: list[np.ndarray], percent: int = 85) -> np.ndarray:
    """Roots of the exact links, 100 * shared >= percent * united. members come by ascending size."""
    sizes = np.array([len(m) for m in members])
    ids = np.unique(np.concatenate(members), return_inverse=True)[1]
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)

    def neighbours(x: int, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rest), bool)
        lo, hi = np.searchsorted(sizes[rest], [-(-percent * sizes[x] // 100), 100 * sizes[x] // percent + 1])
        near = rest[lo:hi]
        if not len(near):
            return out
        mark[ids[start[x]:start[x] + sizes[x]]] = True
        n = sizes[near]
        edge = np.cumsum(n) - n
        shared = np.add.reduceat(mark[ids[np.repeat(start[near] - edge, n) + np.arange(n.sum())]].astype(np.int64), edge)
        mark[ids[start[x]:start[x] + sizes[x]]] = False
        out[lo:hi] = 100 * shared >= percent * (n + sizes[x] - shared)
        return out

    return search(len(members), neighbours)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by key; what is held is one batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            cut = np.insert(cut, 0, 0)
        if not len(cut):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut[-1])])
        held = [batch.slice(cut[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the sketch groups in each node."""
    for table in grouped(batches, "node"):
        node, classes = table["node"].to_numpy(), one_chunk(table["class"])
        raw = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, POSITIONS)
        edge = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
        sizes, at = np.diff(edge), edge[:-1]
        two = at[sizes == 2]
        two = two[(raw[two] == raw[two + 1]).sum(1) >= KEEP]
        a, b = [two], [two + 1]
        for k in np.flatnonzero(sizes > 2):
            root = by_sketch(raw[at[k]:at[k] + sizes[k]])
            new = np.flatnonzero(root != np.arange(len(root)))
            a.append(at[k] + root[new])
            b.append(at[k] + new)
        yield pa.RecordBatch.from_arrays([classes.take(pa.array(np.concatenate(x))) for x in (a, b)], names=["a", "b"])


def one_chunk(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that may be similar, each group of a leaf as a star."""
    rows, edges = classes.select("tokens", "class", "sketch").mapInArrow(_branch(True), NODES), None
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy("node").count().where("count > 1")
        held = settle(rows.join(sizes, "node"))
        small = held.where(F.col("count") <= LIMIT).select("node", "class", "sketch")
        large = held.where(F.col("count") > LIMIT)
        if depth == DEPTH:
            # A leaf that stays large: every two of its blocks meet in a task.
            blocks = F.ceil(2 * F.col("count") / LIMIT).cast("int")
            own = F.pmod(F.xxhash64("class"), blocks).cast("int")
            other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
            large = large.select("node", "class", "sketch", own.alias("own"), other).where("own <> other")
            large = large.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "class", "sketch")
            small = small.union(large)
        found = small.repartition("node").sortWithinPartitions("node").mapInArrow(_compare, "a binary, b binary")
        edges = found if edges is None else edges.union(found)
        if depth == DEPTH or large.isEmpty():
            return edges
        rows = large.select("node", "class", "tokens", "sketch").mapInArrow(_branch(False), NODES)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the chosen rows; a row that only shares the key has another class and goes."""
    for batch in batches:
        for a, b, w in slices(batch, "text", LOWER):
            keep, data = [], []
            for d, s in enumerate(sets(w.hashes(), w.first)):
                if len(s) and name(s) == batch.column("class")[a + d].as_py():
                    keep.append(a + d)
                    data.append(s.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("cluster"), rows.column("class"), rows.column("blocks"), pa.array(data, pa.binary())],
                                             names=["cluster", "class", "blocks", "items"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the exact components in each group."""
    for table in grouped(batches, "group"):
        group = table["group"].to_numpy()
        edge = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        classes, items, blocks = table["class"].to_pylist(), table["items"].to_pylist(), table["blocks"].to_pylist()
        a, b = [], []
        for lo, hi in zip(edge, edge[1:]):
            own = {classes[k]: k for k in range(lo, hi)}  # one row a class
            order = sorted(own.values(), key=lambda k: (len(items[k]), classes[k]))
            root = by_set([np.frombuffer(items[k], np.uint64) for k in order])
            a += order
            b += [order[r] for r in root]
        yield pa.RecordBatch.from_arrays([pa.array([classes[k] for k in a], pa.binary()), pa.array([classes[k] for k in b], pa.binary()),
                                          pa.array([blocks[k] > 1 for k in a], pa.bool_())], names=["a", "b", "open"])


def exact(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, root) of the exact links among the classes of each candidate cluster (node, root)."""
    members = settle(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(classes, "class"))
    weight = members.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / ELEMENTS).cast("int").alias("blocks"))
    chosen = settle(members.join(weight, "cluster").select("row_key", "cluster", "class", "blocks"))
    rows = texts(docs, F.xxhash64("doc_id", "text").alias("row_key")).select("row_key", "text")
    full = rows.join(chosen.hint("shuffle_hash"), "row_key").mapInArrow(_full_sets, "cluster binary, class binary, blocks int, items binary")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = full.select("*", own.alias("own"), other).where("blocks = 1 or own <> other")
    spread = spread.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "class", "blocks", "items")
    links = settle(spread.repartition("group").sortWithinPartitions("group").mapInArrow(_confirm, "a binary, b binary, open boolean"))
    done = links.where("not open").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return done.union(components(links.where("open").select("a", "b")))


def members(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, class (null for an empty set) and first (none, id, key): the least doc_id reachable over links, nulls
    last, and the least row_key under it. Groups have different firsts, even where ids are null or stand for several texts."""
    signed = signatures(docs)
    some = signed.where(F.col("class").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")))
    classes = settle(some.groupBy("class").agg(first.alias("first"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"),
                                               F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    clusters = components(candidates(classes))
    roots = settle(exact(docs, classes.select("class", "row_key", "n_shingles"), clusters))
    joined = settle(roots.join(classes.select(F.col("class").alias("node"), "first"), "node"))
    named = joined.join(joined.groupBy("root").agg(F.min("first").alias("over")), "root").select(F.col("node").alias("class"), "over")
    final = classes.select("class", "first").join(named, "class", "left").select("class", F.coalesce("over", "first").alias("first"))
    return signed.select("doc_id", "row_key", "n_shingles", "class").join(final, "class", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, component_id (the least doc_id reachable over links) and kept (it is that document)."""
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.id"))
    out = members(docs).select("doc_id", "row_key", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def surplus(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, again) of the rows that are too many for one of each group: all rows of a key, or, with again, all rows but one."""
    rows = members(docs).where(F.col("class").isNotNull())
    own = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("row_key") == F.col("first.key"))
    return rows.groupBy("doc_id", "row_key", own.alias("again")).count().where("not again or count > 1").select("doc_id", "row_key", "again")
