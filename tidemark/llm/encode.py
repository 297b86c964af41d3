"""Token ids of whole texts with the tokenizers library, encoding each distinct stretch of text once.

A text is cut where its tokenizer's own pre-tokenizer always cuts: for the byte
tokenizer before a blank that leads a word and around other white space, for the
word tokenizer at white space, for both also between letters, digits and other
visible characters. A stretch seen before, by its 64-bit hash, costs an array
look-up. A new one of a single kind of characters is one pre-token and goes to the
library's model; others go through its normalizer and pre-tokenizer first. Texts
with white space outside ASCII or with the start of a special token are encoded
whole by the library.
"""
from __future__ import annotations

import re
import string
from codecs import charmap_decode
from functools import lru_cache
from itertools import chain

import numpy as np

from .words import BYTE_BASE, PLAIN, SLICE, runs

UNUSUAL = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SLOT_BITS, MOST_IDS = 19, 1 << 21
SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
#: For each byte its kind, LETTER, DIGIT or 3 for other visible characters of ASCII; 0 for white space and all that needs a closer look.
LETTER, DIGIT, APOSTROPHE = 1, 2, ord("'")
KIND = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((string.ascii_letters, string.digits, string.punctuation), LETTER):
    KIND[list(_bytes.encode())] = _kind


def word_cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches without white space."""
    from .words import split
    w = split(buf, offsets, PLAIN)
    return w.starts, w.stops


def byte_cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Stretches ` ?\S+`, `\s+(?!\S)` and `\s+`, in this order of preference."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[buf]
    begin = np.zeros(n, bool)
    # Runs of white space and of other bytes begin at a change, and texts begin anew.
    begin[1:] = space[1:] != space[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = True
    # The last white space before a word leads it if it is a blank, else stands alone.
    word = np.flatnonzero(begin & ~space)
    text_start = np.zeros(n, bool)
    text_start[edges] = True
    word = word[~text_start[word]]
    begin[word[buf[word - 1] == 32]] = False
    begin[word - 1] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of each byte, where U+00C0 to U+00FF but for two signs are letters too."""
    kind = KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] | 0x20) != 0xB7]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def kind_cuts(buf: np.ndarray, kind: np.ndarray, starts: np.ndarray, stops: np.ndarray, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretches cut again where the kind changes, but for an apostrophe's end, as in `'s`; with digits also between digits."""
    left, right = kind[:-1], kind[1:]
    inner = (left != right) & (left > 0) & (right > 0) & (buf[:-1] != APOSTROPHE)
    if digits:
        inner |= (left == DIGIT) & (right == DIGIT)
    inner = np.flatnonzero(inner) + 1
    both = []
    for edges in (starts, stops):
        edge = np.zeros(len(buf) + 1, bool)
        edge[edges] = edge[inner] = True
        both.append(np.flatnonzero(edge))
    return both[0], both[1]


class Encoder:
    """A worker's encoder, see `shared`. Its cache is a table of fixed size, where a newer stretch takes the place of an older one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.by_word = self.normalizer is not None
        self.cuts = word_cuts if self.by_word else byte_cuts
        self.pieces = _pieces(self.by_word)
        self.shown = "".join(_shown()[b] for b in range(256))
        self.clear()

    def clear(self) -> None:
        self.keys, self.where, self.size = (np.zeros(1 << SLOT_BITS, t) for t in (np.uint64, np.int32, np.int32))
        # Room for the ids of one more slice, of a byte each at most. Memory not yet written to is not taken.
        self.ids, self.used = np.empty(MOST_IDS + SLICE, np.uint32), 0

    def new(self, stretch: bytes) -> list[int]:
        text = stretch.decode()
        found = self.pieces(text)
        if found is None:
            if self.normalizer is not None:
                text = self.normalizer.normalize_str(text)
            found = [p for p, _ in self.splitter.pre_tokenize_str(text)]
        tokenize = self.model.tokenize
        return [t.id for p in found for t in tokenize(p)]

    def new_ones(self, buf: np.ndarray, kind: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> list[list[int]]:
        """The ids of each stretch."""
        tokenize, shown, out = self.model.tokenize, self.shown, []
        look = np.flatnonzero((kind == 0) & ~SPACE[buf] | (buf == APOSTROPHE))
        single = np.searchsorted(look, starts) == np.searchsorted(look, stops)
        # A character for each byte, so that places stay the same.
        whole = "" if self.by_word else charmap_decode(raw, "strict", shown)[0]
        for one, a, b in zip(single.tolist(), starts.tolist(), stops.tolist()):
            if not one:
                out.append(self.new(raw[a:b]))
            else:
                piece = charmap_decode(raw[a:b].decode().lower().encode(), "strict", shown)[0] if self.by_word else whole[a:b]
                out.append([t.id for t in tokenize(piece)])
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive texts, and how many each has."""
        raw = buf.tobytes()
        if UNUSUAL.search(raw):
            return self._mixed(buf, offsets, raw)
        return self._common(buf, offsets, raw)

    def _mixed(self, buf, offsets, raw):
        ids, counts = [], []
        odd = [UNUSUAL.search(raw[a:b]) is not None for a, b in zip(offsets, offsets[1:])]
        d = 0
        while d < len(odd):
            e = d + 1
            if odd[d]:
                own = np.array(self.tokenizer.encode(raw[offsets[d]:offsets[e]].decode(), add_special_tokens=False).ids, np.uint32)
                ids.append(own)
                counts.append([len(own)])
            else:
                while e < len(odd) and not odd[e]:
                    e += 1
                a, b = offsets[d], offsets[e]
                own, n = self._common(buf[a:b], offsets[d:e + 1] - a, raw[a:b])
                ids.append(own)
                counts.append(n)
            d = e
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def _common(self, buf, offsets, raw):
        kind = kinds(buf)
        starts, stops = kind_cuts(buf, kind, *self.cuts(buf, offsets), self.by_word)
        h = runs(WHOLE[buf], starts, stops, BYTE_BASE) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != h)
        extra_at, extra_size = None, None
        if len(missing):
            if self.used > MOST_IDS:
                self.clear()
                missing = np.arange(len(h))
            keys, first, place = np.unique(h[missing], return_index=True, return_inverse=True)
            own = self.new_ones(buf, kind, raw, starts[missing[first]], stops[missing[first]])
            size = np.fromiter(map(len, own), np.int64, len(own))
            total = int(size.sum())
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids[:self.used], np.empty(total, np.uint32)])
            self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(own), np.uint32, total)
            where = self.used + np.cumsum(size) - size
            self.used += total
            extra_at, extra_size = where[place], size[place]
        at, n = self.where[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if extra_at is not None:
            at[missing], n[missing] = extra_at, extra_size
            s = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.keys[s], self.where[s], self.size[s] = keys, where, size
            # Of two new ones for a slot numpy keeps the last in each array alike.
        stop = np.cumsum(n)
        ids = self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(at - stop + n, n)]
        edge = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        return ids, np.diff(edge)


@lru_cache(maxsize=1)
def shared(path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    return Encoder(path)


WHOLE = np.arange(1, 257, dtype=np.uint64)


def _pieces(by_word: bool):
    """Pre-tokens of a stretch of characters below U+0250, for which both tokenizers' patterns are plain, or None for others."""
    low = [chr(c) for c in range(0x250)]
    letters, numbers = (re.escape("".join(c for c in low if test(c))) for test in (str.isalpha, str.isnumeric))
    space = r"\s\x85\xa0"
    # The two patterns of the tokenizer files.
    ends = "'s|'t|'re|'ve|'m|'ll|'d"
    pattern = (f"{ends}|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+" if by_word
               else f"{ends}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+")
    find = re.compile(pattern).findall
    simple = re.compile(r"[\t-\r\x20-\x7e\xa1-ɏ]*").fullmatch
    shown = _shown()

    def run(text: str) -> list[str] | None:
        if not simple(text):
            return None
        if by_word:
            text = text.lower()
            if not simple(text):
                return None
        return [p.translate(shown) if p.isascii() and p.isprintable() else "".join(shown[b] for b in p.encode()) for p in find(text)]
    return run


@lru_cache
def _shown() -> dict[int, str]:
    """The character that stands for each byte in the vocabularies: itself if visible, else the next from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}
