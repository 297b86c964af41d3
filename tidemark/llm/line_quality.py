"""Document quality from a linear-chain conditional random field over lines.

A document is a chain of its lines, each good or bad. What a line looks like (LOOKS: length,
letters, digits, marks, repeats) falls into bins; a line's features are its own bins and those of
the lines before and after it, and where it stands. Weights and the four transitions maximise
the likelihood of the labelled documents' lines, whose labels are their document's,
by L-BFGS; each step is one Spark job over the training documents' stored bins. A document's
score is the mean of its lines' marginal probabilities of being good, from the
forward-backward recursion, weighted by their length.

Training takes labelled documents, at most `most` as expected by hash of id and text (each text
under an id once); their number bounds a step's work, not its result's use: every
document is scored, whole. An id with several labels that differ is not used. A null or empty
text is one empty line. Without labels of both kinds no weights are learned, and
every score is the share of good ones among the labels, or a half. No rows in, no rows out.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .words import BYTE_BASE, LOWER, column, parts, runs, split, texts

MOST = 20_000
#: Parts of the training documents: a step sends a gradient for each.
SHARES = 16
SHARE = [0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9]
#: What a line looks like, and where its bins begin.
LOOKS: dict[str, list[float]] = {
    "chars": [1, 10, 25, 60, 120, 250, 600, 2000], "words": [1, 2, 4, 8, 16, 40, 120], "word_length": [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 12, 20],
    "upper": SHARE, "capitals": SHARE, "digits": SHARE, "symbols": SHARE, "stops": SHARE, "loud": SHARE, "bars": SHARE, "slashes": SHARE, "other": SHARE, "high": SHARE,
    "again": SHARE, "distinct": [0.1, 0.2, 0.35, 0.5, 0.7, 0.8, 0.9, 0.97, 0.9999], "single": SHARE, "ending": [1, 2, 3], "seen": [1, 2], "longest": [3, 6, 10, 16, 25, 40, 100],
}
BINS = [len(c) + 1 for c in LOOKS.values()]
#: Where a look's bins begin among the weights; the lines before and after have an own set with one more bin each, no such line.
FIRST = np.concatenate([[0], np.cumsum(BINS)])
OWN = int(FIRST[-1])
WEIGHTS = 3 * OWN + 3
PENALTY = 1.0


def marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


KINDS = {"upper": marks(bytes(range(65, 91))), "lower": marks(bytes(range(97, 123))), "digits": marks(b"0123456789"), "symbols": marks(b"#*$%&<>@^~_={}[]+"), "stops": marks(b".,;:?"),
         "loud": marks(b"!"), "bars": marks(b"|"), "slashes": marks(b"/\\"), "other": marks(b"\"'()-`"), "high": marks(bytes(range(192, 256))), "rest": marks(bytes(range(128, 192))), "blank": marks(b" \t\v\f\r")}


def looks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts in a buffer: where each text's lines begin among all lines, code points of each line, bins of each line (a row of codes)."""
    ends = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], ends + 1]))
    first = np.concatenate([np.arange(len(offsets) - 1) + np.searchsorted(ends, offsets[:-1]), [len(starts)]])
    stops = np.concatenate([starts[1:], [len(buf)]])
    stops = stops - ((stops > starts) & (buf[np.maximum(stops - 1, 0)] == 10)) if len(buf) else stops

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[stops] - total[starts]
    n = {k: within(t[buf]) for k, t in KINDS.items()}
    size = stops - starts
    chars = size - n["rest"]
    w = split(buf, offsets, LOWER)
    hashes, long = w.hashes(), w.stops - w.starts
    line = np.searchsorted(starts, w.starts, "right") - 1
    words = np.bincount(line, minlength=len(starts))
    same_line = line[1:] == line[:-1]
    again = np.bincount(line[1:][same_line & (hashes[1:] == hashes[:-1])], minlength=len(starts))
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(starts))
    single = np.bincount(line[long == 1], minlength=len(starts))
    longest = np.zeros(len(starts), np.int64)
    np.maximum.at(longest, line, long)
    capitals = np.bincount(line[(buf[w.starts] >= 65) & (buf[w.starts] <= 90)], minlength=len(starts)) if len(line) else np.zeros(len(starts), np.int64)
    last = buf[np.maximum(stops - 1, 0)] if len(buf) else np.zeros(len(starts), np.uint8)
    ending = np.where(size == 0, 0, np.where(np.isin(last, list(b".?")), 1, np.where(np.isin(last, list(b"!|:;,")), 2, 3)))
    # Lines with words that stand earlier in their text, once or more often.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = runs((buf + np.uint64(1)).astype(np.uint64), starts, stops, BYTE_BASE)
    order = np.lexsort((np.arange(len(starts)), whole, text))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(order))
    seen = np.zeros(len(order), np.int64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    seen[words == 0] = 0
    letters, of_words, of_chars = np.maximum(n["upper"] + n["lower"], 1), np.maximum(words, 1), np.maximum(chars, 1)
    values = {"chars": chars, "words": words, "word_length": np.maximum(chars - n["blank"], 0) / of_words, "upper": n["upper"] / letters, "capitals": capitals / of_words, "again": again / of_words,
              "distinct": distinct / of_words, "single": single / of_words, "ending": ending, "seen": seen, "longest": longest}
    values |= {k: n[k] / (of_words if k in ("loud", "bars") else of_chars) for k in ("digits", "symbols", "stops", "loud", "bars", "slashes", "other", "high")}
    codes = np.stack([np.searchsorted(cuts, values[k], "right") for k, cuts in LOOKS.items()], axis=1).astype(np.uint8)
    return first, chars, codes


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of id and text), lines, chars and codes (bytes: a line's bins after another) of every document, settled."""
    rows = texts(docs, F.xxhash64("doc_id", "text").alias("row_key"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = column(b.column("text"))
            for i, j in parts(offsets):
                first, chars, codes = looks(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(i, j - i), b.column("row_key").slice(i, j - i), pa.array(np.diff(first).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(chars, pa.int64())),
                    pa.array([codes[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary())], names=["doc_id", "row_key", "lines", "chars", "codes"])
    return settle(rows.mapInArrow(run, "doc_id bigint, row_key bigint, lines int, chars array<bigint>, codes binary"))


class Chains:
    """Chains of lines by falling length, so that a step of the recursions works on the first so many of them at once."""

    def __init__(self, lines: np.ndarray, codes: np.ndarray):
        self.lines = lines
        self.first = np.cumsum(lines) - lines
        codes = codes.reshape(-1, len(BINS)).astype(np.int64) + FIRST[:-1]
        self.own = codes
        begins, ends = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        begins[self.first], ends[self.first + lines - 1] = True, True
        self.begins, self.ends = begins, ends
        by = np.argsort(-lines, kind="stable")
        self.order, self.steps = self.first[by], np.searchsorted(-lines[by], -np.arange(1, lines.max(initial=0) + 1), "right")

    def emissions(self, w: np.ndarray) -> np.ndarray:
        """Each line's score for good over bad."""
        own, before, after = (w[k * OWN:(k + 1) * OWN][self.own].sum(1) for k in range(3))
        s = own + w[3 * OWN]
        s[1:] += np.where(self.begins[1:], w[3 * OWN + 1], before[:-1])
        s[:-1] += np.where(self.ends[:-1], w[3 * OWN + 2], after[1:])
        if len(s):
            s[0] += w[3 * OWN + 1]
            s[-1] += w[3 * OWN + 2]
        return s

    def spread(self, g: np.ndarray) -> np.ndarray:
        """The weights' gradient from the emissions'."""
        out = np.zeros(WEIGHTS)
        k = len(BINS)
        count = lambda codes, v: np.bincount(codes.ravel(), np.repeat(v, k), minlength=OWN)
        out[:OWN] = count(self.own, g)
        inner = ~self.begins[1:]
        out[OWN:2 * OWN] = count(self.own[:-1][inner], g[1:][inner])
        out[2 * OWN:3 * OWN] = count(self.own[1:][inner], g[:-1][inner])
        out[3 * OWN:] = g.sum(), g[self.begins].sum(), g[self.ends].sum()
        return out

    def marginals(self, s: np.ndarray, t: np.ndarray, y: np.ndarray | None = None):
        """P(good) of each line; with y, a label for each chain, also the log likelihood and the expected transitions of all.

        t[a, b]: the score of label b after a. Messages are kept as shares, so that no length of chain under- or overflows.
        """
        step, e = np.exp(t - t.max()), np.stack([np.exp(-np.maximum(s, 0)), np.exp(np.minimum(s, 0))], axis=1)
        forward, backward = np.zeros((len(s), 2)), np.ones((len(s), 2))
        total, pairs = 0.0, np.zeros((2, 2))
        for k, n in enumerate(self.steps):
            at = self.order[:n] + k
            m = (forward[at - 1] @ step if k else 1.0) * e[at]
            z = m.sum(1)
            forward[at] = m / z[:, None]
            total += np.log(z).sum() + (n * t.max() if k else 0.0)
        total += np.maximum(s, 0).sum()
        for k in range(len(self.steps) - 2, -1, -1):
            at = self.order[:self.steps[k + 1]] + k
            m = e[at + 1] * backward[at + 1]
            if y is not None:
                joint = forward[at][:, :, None] * step * m[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            m = m @ step.T
            backward[at] = m / m.sum(1, keepdims=True)
        good = forward * backward
        good = good[:, 1] / good.sum(1)
        if y is None:
            return good
        of_line = np.repeat(y, self.lines)
        moves = self.lines - 1
        seen = np.diag([moves[y == 0].sum(), moves[y == 1].sum()]).astype(float)
        fit = s[of_line == 1].sum() + (seen * t).sum() - total
        return good, fit, seen - pairs, of_line


def chains(batch: pa.RecordBatch) -> Chains:
    joined = b"".join(batch.column("codes").to_pylist())
    return Chains(np.asarray(batch.column("lines")).astype(np.int64), np.frombuffer(joined, np.uint8))


def gradient(sample: DataFrame, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood and its gradient over (lines, codes, label): one job, a row from each of SHARES parts."""
    w, t = x[:WEIGHTS], x[WEIGHTS:].reshape(2, 2)

    def run(batches):
        loss, g = 0.0, np.zeros(WEIGHTS + 4)
        for b in batches:
            if b.num_rows:
                c, y = chains(b), np.asarray(b.column("label")).astype(np.int64)
                good, fit, moved, of_line = c.marginals(c.emissions(w), t, y)
                loss -= fit
                g -= np.concatenate([c.spread(of_line - good), moved.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tolist()], pa.list_(pa.float64()))], names=["loss", "g"])
    got = sample.mapInArrow(run, "loss double, g array<double>").collect()
    # In a fixed order, so that a run repeats to the last bit.
    got.sort(key=lambda r: (r.loss, r.g))
    return sum(r.loss for r in got) + PENALTY * x @ x / 2, np.sum([r.g for r in got], axis=0) + PENALTY * x


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with halving steps; f gives value and gradient."""
    value, g = f(x)
    start, past = np.abs(g).max(), []
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            kept.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(np.abs(g).sum(), 1e-12)
        for (s, y), a in zip(past, reversed(kept)):
            d = d + s * (a - y @ d / (s @ y))
        size = 1.0
        while size > 1e-6:
            new, new_g = f(x + size * d)
            if new <= value + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            return x
        s, y = size * d, new_g - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        x, done, value, g = x + s, value - new < tolerance * 1e-2 * abs(new), new, new_g
        if done or np.abs(g).max() < tolerance * start:
            return x
    return x


def training(described: DataFrame, labels: DataFrame, learn: Column, most: int) -> tuple[DataFrame, int, int]:
    """(lines, codes, label) of labelled documents, settled in SHARES parts, and how many are bad and good. learn: which ids, in terms of doc_id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn)
    known = settle(known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    # Rows of one id are counted before the join, and equal rows of one hash before that, so a hot id is one row there.
    rows = described.select("doc_id", "row_key").distinct().groupBy("doc_id").count().join(known, "doc_id").agg(F.sum("count")).first()[0] or 0
    cut = min(1.0, most / max(rows, 1))
    chosen = described.where(F.pmod("row_key", F.lit(1 << 30)) < int(cut * (1 << 30))).where(F.col("doc_id").isNotNull())
    chosen = chosen.join(known, "doc_id").dropDuplicates(["doc_id", "row_key"]).select("lines", "codes", "label", "row_key")
    chosen = settle(chosen.repartition(SHARES, "row_key").sortWithinPartitions("row_key").drop("row_key"))
    n = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    return chosen, n.get(0, 0), n.get(1, 0)


def fit(described: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> np.ndarray | float:
    """Weights and transitions, or a constant score where there is nothing to tell apart."""
    sample, bad, good = training(described, labels, learn, most)
    if not bad or not good:
        return good / (bad + good) if bad + good else 0.5
    return minimise(lambda x: gradient(sample, x), np.zeros(WEIGHTS + 4))


def lines(described: DataFrame, model: np.ndarray | float) -> DataFrame:
    """doc_id, row_key, score and good (an array: P(good) of each line) of every document."""
    def run(batches):
        for b in batches:
            counts, chars = np.asarray(b.column("lines")).astype(np.int64), np.asarray(b.column("chars").flatten()).astype(float)
            at = np.concatenate([[0], np.cumsum(counts)])
            c = None if isinstance(model, float) or not len(counts) else chains(b)
            good = np.full(len(chars), model) if c is None else c.marginals(c.emissions(model[:WEIGHTS]), model[WEIGHTS:].reshape(2, 2))
            # Documents without characters weigh their empty lines alike.
            chars = np.where(np.repeat(np.add.reduceat(chars, at[:-1]) if len(counts) else chars, counts) == 0, 1.0, chars)
            score = np.add.reduceat(good * chars, at[:-1]) / np.add.reduceat(chars, at[:-1]) if len(counts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(np.clip(score, 0, 1)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(good))], names=["doc_id", "row_key", "score", "good"])
    return described.mapInArrow(run, "doc_id bigint, row_key bigint, score double, good array<double>")


def score(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> DataFrame:
    """doc_id and score of every document, by a model of the labels that learn chooses; see lines for the parts of it."""
    described = describe(docs)
    return lines(described, fit(described, labels, learn, most)).select("doc_id", "score")
