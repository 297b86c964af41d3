"""Token counts of a unigram segmentation, over a trie of pre-tokens.

A pre-token is a word led by the mark U+2581. Its segmentation is the one of
highest total log probability under a vocabulary of pieces; of equal ones that with
fewer tokens. Distinct pre-tokens of a task are inserted in a trie. Each node,
a prefix that words share, keeps the best score and token count of any way to
segment it, worked out once from its ancestors by the pieces that end there; the
count at a word's last node is stored for the word. A character no piece covers
costs one token a byte.

The trie and the stored counts have a fixed size and start anew when full, which
changes nothing but work: memory follows neither the corpus nor its vocabulary,
and no row is shuffled.

A null or empty text has no tokens. Repeated rows are counted each. Extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import PLAIN, rows_of, slices, texts

MARK, NODES, SLOT_BITS = "▁", 400_000, 19
BYTE_SCORE = -20.0


def zipf(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces in order of rank, by Zipf's law."""
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces)))) if pieces else 0.0
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}


def vocabulary(path: str) -> dict[str, float]:
    """The pieces of a public model in its own order, without control and byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return zipf([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))])


class Trie:
    """Prefixes with their best segmentation. Node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> tuple[int, float]:
        """Tokens and log probability of a word."""
        path, node, children = [0], 0, self.children
        for i, char in enumerate(word):
            child = children.get((node, char))
            if child is None:
                child = children[node, char] = len(self.best)
                self._extend(word, i + 1, path)
            node = child
            path.append(node)
        return self.count[node], self.best[node]

    def _extend(self, word: str, stop: int, path: list[int]) -> None:
        best, count, scores = self.best, self.count, self.scores
        # A byte at a time for the last character, which no piece need cover.
        size = len(word[stop - 1].encode("utf-8", "surrogatepass"))
        top, tokens = best[path[stop - 1]] + BYTE_SCORE * size, count[path[stop - 1]] + size
        for start in range(max(0, stop - self.longest), stop):
            s = scores.get(word[start:stop])
            if s is not None:
                s += best[path[start]]
                n = count[path[start]] + 1
                if s > top or s == top and n < tokens:
                    top, tokens = s, n
        best.append(top)
        count.append(tokens)


def _counter(scores: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores)
        keys, tokens, score = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS)
        for batch in batches:
            for a, b, w in slices(batch, "text", PLAIN):
                h = w.hashes() | np.uint64(1)
                every, first, place, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                slot = (every >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                n, s = tokens[slot], score[slot]
                raw = w.buf.tobytes()
                for k in np.flatnonzero(keys[slot] != every):
                    if len(trie.best) > NODES:
                        trie.clear()
                    n[k], s[k] = trie.insert(MARK + raw[w.starts[first[k]]:w.stops[first[k]]].decode())
                keys[slot], tokens[slot], score[slot] = every, n, s
                doc = np.repeat(np.arange(b - a), w.counts)
                add = lambda x: np.bincount(doc, x[place], b - a)
                yield rows_of(batch, a, b, n_pretokens=w.counts, n_tokens=add(n).astype(np.int64), log_prob=add(s))
    return run


def count(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens and log_prob, the segmentation's log probability. scores: the vocabulary, a model file of fixed size."""
    return texts(docs).mapInArrow(_counter(scores), "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_prob double")
