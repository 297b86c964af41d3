"""Word arrays against regular expressions, and the cached encoder against the tokenizers library."""
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm.encode import Encoder
from tidemark.llm.packed import pack, unpack
from tidemark.llm.words import LETTERS, LOWER, PLAIN, column, grams, parts, split

PATTERNS = {"plain": (PLAIN, r"[^\x20\x09-\x0D]+"), "lower": (LOWER, r"[^\x20\x09-\x0D]+"), "letters": (LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n\t\x00\x1cabAB.'1é　<|>日 "), max_size=40), st.text(max_size=20)), max_size=8)


@pytest.mark.parametrize("name", PATTERNS)
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_words_are_those_of_the_pattern(name, texts):
    table, pattern = PATTERNS[name]
    buf, offsets = column(pa.array(texts, pa.string()))
    w = split(buf, offsets, table)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(w.starts[i:j], w.stops[i:j])] for i, j in zip(w.first, w.first[1:])]
    prepare = (lambda s: s.translate(ASCII_LOWER)) if name == "letters" else (lambda s: s)
    want = [re.findall(pattern, prepare(t or "")) for t in texts]
    assert [[x.translate(ASCII_LOWER) if name == "letters" else x for x in doc] for doc in got] == want
    h = w.hashes()
    flat = [x if name == "plain" else x.translate(ASCII_LOWER) for doc in got for x in doc]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_gram_hashes_tell_runs_apart():
    h = np.random.default_rng(1).integers(0, 5, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = grams(h, 3)
    runs = [tuple(h[i:i + 3].tolist()) for i in range(len(h) - 2)]
    assert len(g) == len(runs) and len(set(zip(runs, g.tolist()))) == len(set(runs)) == len(set(g.tolist()))
    assert len(grams(h[:2], 3)) == 0


def test_parts_cover_all_rows():
    offsets = np.array([0, 3, 3, 50, 52, 60, 60])
    assert list(parts(offsets, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(parts(np.array([0]), 10)) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), max_size=50))
def test_packing_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert (unpack(pack(a, True), np.uint64, True) == a).all() and (unpack(pack(a[::-1].copy()), np.uint64) == a[::-1]).all()


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=80, deadline=None)
@given(texts=TEXTS)
def test_ids_equal_the_library(file, texts):
    e = encoder(file)
    buf, offsets = column(pa.array(texts, pa.string()))
    ids, n = e.encode(buf, offsets) if texts else (np.zeros(0), np.zeros(0, int))
    edge = np.concatenate([[0], np.cumsum(n)]).astype(int)
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == want


_made = {}


def encoder(file):
    if file not in _made:
        _made[file] = Encoder(public_tokenizers.path(file))
    return _made[file]


def test_a_full_cache_changes_nothing(monkeypatch):
    from tidemark.llm import encode
    monkeypatch.setattr(encode, "MOST_IDS", 10)
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} and others {i % 7} again" for i in range(200)]
    for _ in range(3):
        buf, offsets = column(pa.array(texts))
        ids, n = e.encode(buf, offsets)
        assert ids.tolist() == [i for t in texts for i in e.tokenizer.encode(t).ids]


KINDS = "abesStTdlmrvLL''''12²½.,-#<=`_ \n\téÉßÀÿ×÷ªµŠİǅ̸́̇\x1c\x7f日"


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(KINDS), max_size=60), min_size=1, max_size=6))
def test_cuts_between_kinds_of_characters_change_no_id(file, texts):
    e = encoder(file)
    buf, offsets = column(pa.array(texts, pa.string()))
    ids, n = e.encode(buf, offsets)
    edge = np.concatenate([[0], np.cumsum(n)]).astype(int)
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_encoded_once_whatever_signs_follow(file):
    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, piece):
            self.calls += 1
            return self.model.tokenize(piece)

    e = Encoder(public_tokenizers.path(file))
    e.model = Counted(e.model)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)]
    text = "".join(f" {w}{sign}" for sign in ("", ".", ",", "###", "!!", "5") for w in words)
    buf, offsets = column(pa.array([text]))
    ids, _ = e.encode(buf, offsets)
    assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.model.calls == len(words) + 5
