"""A bigram language model by deleted interpolation.

P(w | u) mixes the maximum-likelihood bigram, the maximum-likelihood unigram and
an even share over the vocabulary and one unknown word. The mixture weights
depend on how often the context u was seen, in buckets of a factor of two; EM
learns them on held-out counts, each training token being held out of the counts
in its turn: (c(u,w)-1)/(c(u)-1) against (c(w)-1)/(N-1).

Every training text is counted. Units of documents (see `units`) send each of
their distinct words and word pairs with its count once; ranges of hash values
add them up and send the totals back. For EM, tokens are counted in a table by
context bucket and by their two probabilities in eighths of a power of two,
which keeps the sums of the probabilities; the table's size is bounded by the
range of numbers, not by the corpus, so the weights are fitted from it at once.

A null or empty text is one token, its end. Repeated rows count and are scored
each for itself. Without training text N and V are 0 and every token gets the
even share. Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .packed import pack, unpack
from .units import cuts, deal
from .words import LOWER, WORD_BASE, column, mix, parts, split

END, START = np.uint64(0x3C2F733E), np.uint64(0x3C733E)
LEVELS, STEP, DEEPEST = 64, 8, 512


def tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by END, and the place of each text's first."""
    buf, offsets = column(text)
    hs, sizes = [], []
    for a, b in parts(offsets):
        w = split(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], LOWER)
        hs.append(np.insert(w.hashes(), w.first[1:], END))
        sizes.append(w.counts + 1)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return (np.concatenate(hs) if hs else np.zeros(0, np.uint64)), first


def pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it, of 56 bits: a byte less to send for each pair, and a wrong count for one pair in
    thousands at most at 10**13 different ones."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = START
    return mix(before * np.uint64(WORD_BASE) + h) & np.uint64(0xFFFFFFFFFFFFFF00)


COUNTS = "unit int, kind int, range int, keys binary, counts binary"
REPLY = "unit int, kind int, range int, totals binary, distinct bigint"
COUNTED = ("doc_ids array<bigint>, train array<boolean>, n_tokens array<bigint>, pair_counts binary, word_counts binary, starts bigint, distinct bigint, "
           "histogram array<struct<level:int,pair_bin:int,word_bin:int,n:double,pair_sum:double,word_sum:double>>")


def arrow(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _counter(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, first = tokens(table["text"])
        train = np.repeat(table["train"].to_numpy(), np.diff(first))
        rows = []
        for kind, values in ((1, h), (2, pairs(h, first))):
            keys, place = np.unique(values, return_inverse=True)
            n = np.bincount(place, train, len(keys)).astype(np.uint32)
            at = cuts(keys, ranges)
            rows += [(key[0].as_py(), kind, r, pack(keys[a:b], True), pack(n[a:b])) for r, (a, b) in enumerate(zip(at, at[1:]))]
        return arrow(rows, [("unit", pa.int32()), ("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    return run


def _adder(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of one range of hash values for each unit, in the order of the keys it sent; the first also hears how many keys have a count."""
    units, packed, counts = (table[c].to_pylist() for c in ("unit", "keys", "counts"))
    keys = [unpack(k, np.uint64, True) for k in packed]
    edge = np.cumsum([0, *map(len, keys)])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    n = np.zeros(len(every), np.uint64)
    for c, a, b in zip(counts, edge, edge[1:]):
        n[place[a:b]] += unpack(c, np.uint32)
    rows = [(u, key[0].as_py(), key[1].as_py(), pack(n[place[a:b]]), int((n > 0).sum()) if k == 0 else 0)
            for k, (u, a, b) in enumerate(zip(units, edge, edge[1:]))]
    return arrow(rows, [("unit", pa.int32()), ("kind", pa.int32()), ("range", pa.int32()), ("totals", pa.binary()), ("distinct", pa.int64())])


def level(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def contexts(word: np.ndarray, first: np.ndarray, starts: int) -> np.ndarray:
    """How often each token's context was seen in training: the word before, or the start of a text."""
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = starts
    return context


def _bins(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(np.abs(np.log2(np.maximum(p, 1e-300))) * STEP, 0, DEEPEST), DEEPEST + 1).astype(np.int64)


def _counted(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
    """A unit's tokens with their training counts, and how often its training tokens have which deleted probabilities."""
    h, first = tokens(table["text"])
    rows = sorted(replies.to_pylist(), key=lambda r: (r["kind"], r["range"]))
    totals = {kind: np.concatenate([unpack(r["totals"], np.uint64) for r in rows if r["kind"] == kind]).astype(np.int64) for kind in (1, 2)}
    words, place = np.unique(h, return_inverse=True)
    word, starts = totals[1][place], int(totals[1][np.searchsorted(words, END)])
    pair = totals[2][np.unique(pairs(h, first), return_inverse=True)[1]]
    train = np.repeat(table["train"].to_numpy(), np.diff(first)).astype(bool)
    context = contexts(word, first, starts)[train] - 1
    p2, c1 = np.where(context > 0, (pair[train] - 1) / np.maximum(context, 1), 0.0), (word[train] - 1).astype(float)
    wide = DEEPEST + 2
    codes, at = np.unique((level(context) * wide + _bins(p2)) * wide + _bins(c1), return_inverse=True)
    n, s2, s1 = np.bincount(at, minlength=len(codes)), np.bincount(at, p2, len(codes)), np.bincount(at, c1, len(codes))
    histogram = pa.StructArray.from_arrays([*[pa.array(x.astype(np.int32)) for x in (codes // wide ** 2, codes // wide % wide, codes % wide)],
                                            *[pa.array(x.astype(float)) for x in (n, s2, s1)]], ["level", "pair_bin", "word_bin", "n", "pair_sum", "word_sum"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    flat = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
    return pa.table([one(flat("doc_id")), one(flat("train")), one(pa.array(np.diff(first))), pa.array([pack(pair.astype(np.uint64))], pa.binary()),
                     pa.array([pack(word.astype(np.uint64))], pa.binary()), pa.array([starts]),
                     pa.array([sum(r["distinct"] for r in rows if r["kind"] == 1)], pa.int64()), one(histogram)],
                    names=["doc_ids", "train", "n_tokens", "pair_counts", "word_counts", "starts", "distinct", "histogram"])


def expectation_maximisation(levels: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights by level, (LEVELS, 3), for rows of three probabilities seen n times; a level never seen keeps even weights."""
    weights = np.full((LEVELS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    for k in np.unique(levels):
        own, seen, w = p[levels == k], n[levels == k], weights[k]
        for _ in range(rounds):
            share = own * w
            share /= share.sum(1, keepdims=True)
            # Nothing becomes impossible.
            new = np.maximum((share * seen[:, None]).sum(0) / seen.sum(), [0 if k == 0 else 1e-6, 1e-6, 1e-6])
            new /= new.sum()
            done, w = np.abs(new - w).max() < 1e-10, new
            if done:
                break
        weights[k] = w
    return weights


def mixture(pair: np.ndarray, word: np.ndarray, context: np.ndarray, total: int, vocabulary: int, weights: np.ndarray) -> np.ndarray:
    """P(w | u) of each token from its counts."""
    w = weights[level(context)]
    return w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (vocabulary + 1)


def _scorer(total: int, vocabulary: int, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = batch.column("n_tokens")[r].values.to_numpy()
                first = np.concatenate([[0], np.cumsum(sizes)])
                pair = unpack(batch.column("pair_counts")[r].as_py(), np.uint64).astype(np.int64)
                word = unpack(batch.column("word_counts")[r].as_py(), np.uint64).astype(np.int64)
                p = mixture(pair, word, contexts(word, first, batch.column("starts")[r].as_py()), total, vocabulary, weights)
                base = np.log10((word + 1) / (total + vocabulary + 1))
                add = lambda x: np.add.reduceat(x, first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[r].values, pa.array(~batch.column("train")[r].values.to_numpy(zero_copy_only=False)), pa.array(sizes),
                     pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(sizes), total)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Learns from the documents where train holds and scores all of them."""
    dealt = deal(docs, F.coalesce(train, F.lit(True)).alias("train"))
    # The same frame as below, so that the texts are dealt once.
    counts = dealt.docs.groupBy("unit").applyInArrow(_counter(dealt.ranges), COUNTS)
    replies = counts.groupBy("kind", "range").applyInArrow(_adder, REPLY)
    counted = settle(dealt.docs.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(_counted, COUNTED))
    table = counted.select(F.explode("histogram").alias("h")).select("h.*").groupBy("level", "pair_bin", "word_bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "pair_sum", "word_sum")]).toPandas()  # bounded by LEVELS * (DEEPEST + 2)**2, a few thousand in practice
    vocabulary, total = int(counted.agg(F.sum("distinct")).first()[0] or 0), int(table.n.sum())
    p = np.stack([table.pair_sum / table.n, table.word_sum / table.n / max(total - 1, 1), np.full(len(table), 1 / (vocabulary + 1))], 1)
    weights = expectation_maximisation(table.level.to_numpy(), p, table.n.to_numpy())
    return counted.drop("histogram").mapInArrow(_scorer(total, vocabulary, weights), SCORES)
