"""Quality rules by weak supervision.

Each rule votes for keeping a document, against it, or abstains. No labels are
used: expectation-maximisation over the votes estimates the share of good
documents and how often each rule's votes are right, and a
document stays if its posterior probability of being good reaches a threshold.
EM needs no documents, only how often each pattern of votes occurs; there are at
most 3**rules patterns however many documents there are, so the counts of all
documents are added up by Spark and the fit runs on that small table.

A null or empty text has no words: its rules abstain or vote against, and it is
never kept (n_words < 50). Repeated rows are rows of their own. An empty table
gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .words import PLAIN, Words, grams, rows_of, slices, texts

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_distinct_words")
RULES: dict[str, Callable[[Callable[[str], Column]], tuple[Column, Column]]] = {
    # name: (votes for, votes against); neither holding is an abstention.
    "length": lambda c: (c("n_words") >= 80, c("n_words") < 50),
    "word_length": lambda c: (c("word_chars").between(3 * c("n_words"), 10 * c("n_words")),
                              (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
    "symbols": lambda c: (F.lit(False), 10 * c("n_symbols") > c("n_words")),
    "letters": lambda c: (F.lit(False), 10 * c("n_letters") < 7 * c("word_chars")),
    "repeated_lines": lambda c: (F.lit(False), (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
    "repeated_words": lambda c: (F.lit(False), 10 * c("n_repeat_words") > 3 * c("n_words")),
    "capitals": lambda c: (F.lit(False), 10 * c("n_capitals") > 4 * c("n_letters")),
    "vocabulary": lambda c: (4 * c("n_distinct_words") >= c("n_words"), 10 * c("n_distinct_words") < c("n_words")),
}
#: How often a vote against, and one for, is right, and the share of good documents, before any is seen: the rules against are narrow,
#: those for only rule out some faults.
PRIOR, SHARE = np.array([0.97, 0.55]), 0.7


def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def distinct(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(h[a:b])) for a, b in zip(first, first[1:])], np.int64)


def repeated(w: Words, h: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that it has twice or more."""
    g, left, hit = grams(h, 3), w.left(), np.zeros(len(h), bool)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    at = np.flatnonzero(left[:len(g)] >= 3)
    order = at[np.lexsort((g[at], doc[at]))]
    same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    for k in range(3):
        hit[order[again] + k] = True
    return per_text(hit, w.first)


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text with a word, and those equal to an earlier one."""
    n, dup = np.zeros(len(w.counts), np.int64), np.zeros(len(w.counts), np.int64)
    ends = np.flatnonzero(w.buf == 10)
    bounds = np.searchsorted(ends, w.edges)
    raw = w.buf.tobytes()
    for d, (a, b) in enumerate(zip(w.edges, w.edges[1:])):
        if bounds[d] == bounds[d + 1]:
            n[d] = w.counts[d] > 0
            continue
        full = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\v\f\r")]
        n[d], dup[d] = len(full), len(full) - len(set(full))
    return n, dup


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead = (np.arange(256) & 0xC0) != 0x80
    letter = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)])
    capital = np.isin(np.arange(256), range(65, 91))
    for batch in batches:
        for a, b, w in slices(batch, "text", PLAIN):
            h = w.hashes()
            n_lines, dup = lines(w)
            inside = (PLAIN != 0)[w.buf]
            yield rows_of(batch, a, b, row_key=batch.column("row_key").slice(a, b - a), n_words=w.counts, word_chars=per_text(lead[w.buf] & inside, w.edges), n_symbols=per_text(SYMBOLS[w.buf], w.edges),
                          n_dup_lines=dup, n_repeat_words=repeated(w, h), n_lines=n_lines, n_letters=per_text(letter[w.buf], w.edges),
                          n_capitals=per_text(capital[w.buf], w.edges), n_distinct_words=distinct(w.first, h))


def measure(docs: DataFrame) -> DataFrame:
    """MEASURES of every text, all of it, beside doc_id and row_key, a hash of id and text."""
    rows = texts(docs, F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(_measured, "doc_id bigint, row_key bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))


def votes(measured: DataFrame, rules=None) -> DataFrame:
    """Adds a column per rule: 1 keeps, 0 rejects, null abstains."""
    out = {}
    for name, rule in (rules or RULES).items():
        yes, no = rule(F.col)
        out[f"vote_{name}"] = F.when(no, 0).when(yes, 1)
    return measured.withColumns(out)


def fit(patterns: np.ndarray, counts: np.ndarray, trust: float = 4.0, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for rules that err independently: the share of good documents, and how often each rule's votes are right, as (rule, against or for).

    patterns: (n, rules) of 0 against, 1 for, 2 abstains; an abstention says
    nothing. PRIOR and SHARE count as much as trust times the votes and the
    documents seen, so a rule is believed less when the others contradict it,
    yet rules that happen to agree cannot turn the classes round.
    """
    share, right = SHARE, np.tile(PRIOR, (patterns.shape[1], 1))
    if not counts.sum():
        return share, right
    cast = [(patterns == side) * counts[:, None] for side in (0, 1)]
    for _ in range(rounds):
        good = posterior(patterns, share, right)[:, None]
        before = right
        right = np.stack([((trust * cast[side].sum(0) + 2) * PRIOR[side] + (cast[side] * (good if side else 1 - good)).sum(0))
                          / ((1 + trust) * cast[side].sum(0) + 2) for side in (0, 1)], 1)
        share = float((trust * SHARE + (good[:, 0] * counts).sum() / counts.sum()) / (1 + trust))
        if np.abs(right - before).max() < 1e-12:
            break
    return share, right


def weights(right: np.ndarray) -> np.ndarray:
    """What each vote adds to the log odds of good."""
    odds = np.log(right) - np.log(1 - right)
    return odds * np.array([-1.0, 1.0])


def posterior(patterns: np.ndarray, share: float, right: np.ndarray) -> np.ndarray:
    w = weights(right)
    odds = np.log(share) - np.log(1 - share) + sum(((patterns == side) * w[:, side]).sum(1) for side in (0, 1))
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, rules=None) -> DataFrame:
    """One row a document: doc_id, row_key, MEASURES, a vote per rule, quality (the posterior) and good (quality >= threshold)."""
    rules = rules or RULES
    voted = settle(votes(measure(docs), rules))
    names = [f"vote_{r}" for r in rules]
    table = voted.groupBy(*names).count().toPandas()  # at most 3**rules rows
    patterns = table[names].astype("float").fillna(2).astype(int).to_numpy()
    share, right = fit(patterns, table["count"].to_numpy(float))
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for name, (against, given) in zip(names, weights(right)):
        odds = odds + F.when(F.col(name) == 1, float(given)).when(F.col(name) == 0, float(against)).otherwise(0.0)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("good", F.col("quality") >= threshold)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
