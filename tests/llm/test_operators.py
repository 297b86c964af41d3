"""Each operator on odd rows and on no rows, against brute force."""
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, components, decontaminate, licenses, near, ngrams, packed, packing, quality, queries, substrings, token_counts, token_files, units

from . import brute


def key(r):
    return tuple((x is not None, x) for x in r)


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert got == want


@pytest.fixture(scope="module")
def items(spark, words):
    passage, other = words(50, 2), words(30, 9)
    rows = [(1, " ".join(passage[5:30])), (2, " ".join(passage[20:45])), (3, " ".join(words(20_000, 3)[700:716])), (4, "One"), (5, None), (6, " ,. "), (None, " ".join(other)),
            (8, "another, TEXT under one id"), (1, " ".join(passage[5:30]))]
    return spark.createDataFrame(rows, "item_id bigint, text string"), rows


def test_decontamination(odd_docs, odd_rows, items, monkeypatch):
    df, rows = items
    for chunk in (50_000, 7):
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        monkeypatch.setattr(decontaminate.search, "__defaults__", (0, chunk))
        got = decontaminate.contamination(odd_docs, df)
        assert got.count() == len(odd_rows)
        same([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got.collect()], brute.contamination(odd_rows, rows))


def test_decontamination_without_rows(odd_docs, odd_rows, no_docs, items, spark):
    assert decontaminate.contamination(no_docs, items[0]).count() == 0
    got = decontaminate.contamination(odd_docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert got.where("n_hit > 0 or contaminated").count() == 0 and got.count() == len(odd_rows)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "red big fox runs"), (2, "red fox runs"), (3, "fox then something else entirely red"), (4, "red"), (5, "fox runs")], "doc_id bigint, text string")
    indexed = decontaminate.index(docs)
    phrase = decontaminate.windows(spark.createDataFrame([(1, "red fox")], "item_id bigint, text string"))

    def found(slop):
        ids = indexed.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
        return sorted(r.doc_id for r in decontaminate.search(indexed, phrase, slop).join(ids, ["block", "place"]).collect())
    assert found(0) == [2] and found(1) == [1, 2] and found(decontaminate.GAP - 1) == [1, 2, 3]
    with pytest.raises(ValueError):
        decontaminate.search(indexed, phrase, decontaminate.GAP)


@pytest.mark.parametrize("unit_bytes", [1 << 22, 700])
@pytest.mark.parametrize("window", [35, 4])
def test_repeated_passages_go(odd_docs, odd_rows, window, unit_bytes, monkeypatch):
    monkeypatch.setattr(units.deal, "__kwdefaults__", {"unit_bytes": unit_bytes})
    got = substrings.repeats(odd_docs, window)
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], brute.repeats(odd_rows, window))
    left = substrings.remove(odd_docs, window)
    assert left.columns == odd_docs.columns and left.where("unit <> 'unit' or rest <> 'rest'").count() == 0
    want = [(d, t if not gone else kept) for (d, t), (_, n, gone, kept) in zip(odd_rows, brute.repeats(odd_rows, window)) if not gone or gone < n]
    same([(r.doc_id, r.text) for r in left.collect()], want)


def test_repeats_without_rows(no_docs):
    assert substrings.repeats(no_docs).count() == 0


def test_matching_a_range_of_hashes_needs_little_beside_them():
    import tracemalloc
    rng = np.random.default_rng(5)
    n, units = 40_000, 30
    keys = [np.unique(rng.integers(0, 1 << 26, n).astype(np.uint64)) for _ in range(units)]
    flags = [(rng.integers(0, 4, len(k)) & rng.integers(0, 4, len(k))).astype(np.uint8) for k in keys]
    checks = [k // np.uint64(2) + (rng.random(len(k)) < 0.1).astype(np.uint64) for k in keys]

    def matched(extra):
        table = pa.table([pa.array(range(units), pa.int32()), pa.array([packed.pack(k, True) for k in keys], pa.binary()),
                          pa.array([packed.pack(c) for c in extra] if extra else [None] * units, pa.binary()), pa.array([packed.pack(f) for f in flags], pa.binary())],
                         names=["unit", "keys", "checks", "flags"])
        tracemalloc.start()
        got = substrings._matched((None,), table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return {u: packed.unpack(k, np.uint64, True).tolist() for u, k in zip(got["unit"].to_pylist(), got["keys"].to_pylist())}, peak / sum(map(len, keys))

    n_of, blocks = Counter(), set()
    for k, f in zip(keys, flags):
        n_of.update(dict(zip(k.tolist(), (1 + (f & 1)).tolist())))
        blocks.update(k[(f & 2) > 0].tolist())
    got, bytes_each = matched(None)
    assert got == {u: [x for x in k.tolist() if n_of[x] > 1 and x in blocks] for u, k in enumerate(keys)} and bytes_each < 32
    n_of = Counter()
    for k, c, f in zip(keys, checks, flags):
        n_of.update(dict(zip(zip(k.tolist(), c.tolist()), (1 + (f & 1)).tolist())))
    got, bytes_each = matched(checks)
    assert got == {u: [x for x, y in zip(k.tolist(), c.tolist()) if n_of[x, y] > 1] for u, (k, c) in enumerate(zip(keys, checks))} and bytes_each < 45


@pytest.mark.parametrize("limits", [(2000, 1_500_000), (3, 300)])
def test_near_duplicates(odd_docs, odd_rows, spark, words, limits, monkeypatch):
    """Small limits branch every node and cut every cluster into blocks."""
    monkeypatch.setattr(near, "LIMIT", limits[0])
    monkeypatch.setattr(near, "ELEMENTS", limits[1])
    rng, base, more = random.Random(5), words(90, 77), []
    for i in range(40):
        text = list(base)
        for k in rng.sample(range(90), rng.randint(0, 6)):
            text[k] = f"new{i}{k}"
        more.append((500 + i, " ".join(text)))
    docs = odd_docs.select("doc_id", "text", "class", "node").union(spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("*", "'a'", "'b'"))
    got = near.near_duplicates(docs)
    same([(r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in got.collect()], brute.near(odd_rows + more))


def test_near_duplicates_without_rows(no_docs):
    assert near.near_duplicates(no_docs).count() == 0


def test_exact_links_match_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for i in range(120):
        s = base.copy()
        s[rng.choice(200, rng.integers(0, 30), replace=False)] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    sets.sort(key=len)
    root = near.by_set(sets)
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if link(sets[a], sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    assert {(root[a] == root[b]) == (label[a] == label[b]) for a in range(len(sets)) for b in range(a)} == {True}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (129, 130), (130, 130)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 131)}, 300: 300}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_quality_measures(odd_docs, odd_rows, no_docs):
    got = quality.judge(odd_docs)
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()], [(d, *brute.measures(t)) for d, t in odd_rows])
    assert got.where("good is null or quality not between 0 and 1").count() == 0
    assert quality.judge(no_docs).count() == 0


def test_label_model_finds_accuracies():
    """Narrow rules fire on most bad documents, another at random: it is trusted less, and the posterior sorts the classes."""
    rng = np.random.default_rng(11)
    truth = rng.random(20_000) < 0.8
    patterns = np.full((20_000, 5), 2)
    for k, (bad, good) in enumerate(((0.7, 0.01), (0.6, 0.02), (0.7, 0.02), (0.15, 0.15))):
        patterns[rng.random(20_000) < np.where(truth, good, bad), k] = 0
    patterns[rng.random(20_000) < np.where(truth, 0.9, 0.5), 4] = 1
    rows, n = np.unique(patterns, axis=0, return_counts=True)
    share, right = quality.fit(rows, n.astype(float))
    assert abs(share - 0.8) < 0.2 and right[:3, 0].min() > right[3, 0]
    sure = patterns[:, 3] == 2
    assert ((quality.posterior(patterns, share, right) > 0.5) == truth)[sure].mean() > 0.95
    assert quality.fit(np.zeros((0, 4), int), np.zeros(0))[0] == quality.SHARE


def test_language_model(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(units.deal, "__kwdefaults__", {"unit_bytes": 900})
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    seen = {}
    kept = ngrams.mixture
    monkeypatch.setattr(ngrams, "_scorer", lambda total, vocabulary, weights: seen.update(n=total, v=vocabulary, w=weights) or _scorer(total, vocabulary, weights))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = ngrams.score(odd_docs, fold).collect()
    tokens, one, two = brute.bigram_model(odd_rows, train)
    n, v = sum(one.values()), len(one)
    assert (seen["n"], seen["v"]) == (n, v)
    want = []
    for (doc, _), w in zip(odd_rows, tokens):
        base = sum(brute.log10((one[x] + 1) / (n + v + 1)) for x in w)
        contexts = [one[None], *[one[x] for x in w[:-1]]]
        pairs = [two[p] for p in zip(["^", *w], w)]
        p = kept(np.array(pairs), np.array([one[x] for x in w]), np.array(contexts), n, v, seen["w"])
        want.append((doc, not train(doc), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(float(np.log10(p).sum()), 6)))
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got], want)
    assert ngrams.score(no_docs, fold).count() == 0


_scorer = ngrams._scorer


def test_mixture_is_a_distribution_and_em_climbs():
    weights = ngrams.expectation_maximisation(np.array([3, 3, 5]), np.array([[0.5, 0.1, 0.01], [0.0, 0.2, 0.01], [0.3, 0.3, 0.01]]), np.array([10.0, 5.0, 1.0]))
    assert np.allclose(weights.sum(1), 1) and weights[3, 0] > 0.3 and weights[0, 0] == 0
    # Over the vocabulary and one unknown word, for a context seen 4 times: counts of pairs sum to 4, of words to N.
    p = ngrams.mixture(np.array([3, 1, 0, 0]), np.array([5, 3, 2, 0]), np.full(4, 4), 10, 3, weights)
    assert abs(p.sum() - 1) < 1e-12


def test_packing(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(odd_docs, path), pool=7).collect()
    want = []
    for doc, text in odd_rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc, k, k * 4096, len(ids[k * 4096:(k + 1) * 4096]), brute.crc(ids[k * 4096:(k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert packing.pack(packing.pieces(no_docs, path)).count() == 0


def test_genetic_packing_keeps_pieces_and_improves():
    rng = np.random.default_rng(2)
    # Triples that fill a sequence exactly: best-fit of longest first misses some.
    cuts = np.sort(rng.integers(200, 800, (300, 2)), axis=1)
    lengths = np.concatenate([cuts[:, 0], cuts[:, 1] - cuts[:, 0] + 1, 1000 - cuts[:, 1] - 1]).astype(np.int64)
    first = packing.best_fit(np.zeros(len(lengths), np.int64), lengths, np.argsort(-lengths, kind="stable"), 1000)
    population = []
    for epoch in range(6):
        population = packing.evolve(lengths, population, 1000, epoch)
    for g in [first, *population]:
        assert np.bincount(g, lengths).max() <= 1000 and (np.bincount(g) > 0).all()
    assert packing.fitness(population[0], lengths) <= packing.fitness(first, lengths)
    child = packing.cross(population[0], population[-1], lengths, 1000, rng)
    assert len(child) == len(lengths) and np.bincount(child, lengths).max() <= 1000


def test_token_files_round_trip(odd_docs, odd_rows, no_docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    folder = token_files.folder(spark)
    token_files.write(odd_docs, path, folder)
    got = sorted(token_files.read(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id) for r in got] == sorted((r.doc_id is not None, r.doc_id) for r in got)
    encoded = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in odd_rows]
    same([(r.doc_id, tuple(r.ids), r.n_tokens, r.ids_crc32) for r in got], [(d, tuple(i), len(i), brute.crc(i)) for (d, _), i in zip(odd_rows, encoded)])
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    (ids,) = token_files.fetch(spark, folder, 5)
    assert ids.tolist() == [*t.encode("one two").ids, 2] and len(token_files.fetch(spark, folder, 7)) == 2 and token_files.fetch(spark, folder, -9) == []
    empty = token_files.folder(spark)
    token_files.write(no_docs, path, empty)
    assert token_files.read(spark, empty).count() == 0


def test_token_files_refuse_another_dictionary(spark, words):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), token_files.folder(spark)
    docs = spark.createDataFrame([(i, " ".join(words(40, i))) for i in range(300)], "doc_id bigint, text string")
    token_files.write(docs, path, folder)
    assert len(token_files.load_dictionary(spark, folder)) > 0
    row = spark.read.parquet(f"{folder}/blocks").first().asDict()
    with pytest.raises(ValueError):
        token_files.decode(row, b"other")


def test_token_counts(odd_docs, odd_rows, no_docs, monkeypatch):
    scores = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def segment(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            options = [(-(best[e - 1][0] + token_counts.BYTE_SCORE * size), best[e - 1][1] + size)]
            options += [(-(best[s][0] + scores[word[s:e]]), best[s][1] + 1) for s in range(max(0, e - longest), e) if word[s:e] in scores]
            top = min(options)
            best.append((-top[0], top[1]))
        return best[-1]
    monkeypatch.setattr(token_counts, "NODES", 500)
    want = []
    for doc, text in odd_rows:
        own = [segment("▁" + w) for w in brute.words(text)]
        want.append((doc, len(own), sum(n for _, n in own), round(sum(s for s, _ in own), 4)))
    same([(r.doc_id, r.n_pretokens, r.n_tokens, round(r.log_prob, 4)) for r in token_counts.count(odd_docs, scores).collect()], want)
    assert token_counts.count(no_docs, scores).count() == 0
    assert token_counts.Trie({}).insert("ab") == (2, 2 * token_counts.BYTE_SCORE)


def test_licenses(odd_docs, odd_rows, no_docs, spark):
    got = licenses.scan(odd_docs)
    assert got.count() == len(odd_rows) and got.where("license is not null or notices <> ''").count() == 0 and licenses.scan(no_docs).count() == 0
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "MIT licence\n" + mit), (3, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE")),
            (4, mit.replace(" ", "\n  ").replace(",", " ,;")), (5, "Some text.\n// Licensed under the Apache Licence, version 2.0\nmore"), (6, mit[:-9]),
            (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (8, None)]
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: ("MIT", ""), 2: ("MIT", ""), 3: ("MIT", ""), 4: ("MIT", ""), 5: (None, "Apache-2.0"), 6: (None, ""), 7: (None, "CC-BY-NC-4.0,MIT"), 8: (None, "")}


def test_license_oracle(spark, tmp_path):
    """The query's SQL finds what the operator finds, in texts of every known licence and in notices."""
    texts = [t for _, t in licenses.known_texts()]
    texts += ["\n".join(textwrap.wrap(t, 60)) for t in texts[::3]] + ["Copyright (c) 2020 A\n(c) the project authors\n© Someone\nCopyright the holders, all\n" + t.upper() for t in texts[::5]]
    texts += [f"Code.\n# {n}\nmore" for _, n in licenses.known_notices()[::7]] + ["copyright notice\n(c) 2020", "Copyright (c) the authors", "copyright", "©", "", None, "MIT License"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op6_license_scan"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(queries.ORACLES["op6_license_scan"]).fetchall())
    assert {n for _, _, names, _ in got if names for n in names.split(",")} == {n for n, _ in licenses.known_texts()}


def test_counts_beyond_32_bits():
    """A token seen more often than 32 bits can count keeps its number."""
    texts, many = pa.table({"doc_id": [1], "text": ["aa bb aa"], "train": [True]}), 5_000_000_000
    h, first = ngrams.tokens(texts["text"])
    rows = []
    for kind, n in ((1, len(np.unique(h))), (2, len(np.unique(ngrams.pairs(h, first))))):
        rows.append({"kind": kind, "range": 0, "totals": packed.pack(np.arange(n, dtype=np.uint64) + np.uint64(many)), "distinct": n})
    out = ngrams._counted((), texts, pa.Table.from_pylist(rows))
    for c, n in (("word_counts", 3), ("pair_counts", 4)):
        got = packed.unpack(out.column(c)[0].as_py(), np.uint64)
        assert len(got) == 4 and sorted(set(got.tolist())) == [many + k for k in range(n)]


def test_chat(spark):
    odd = "</s>[INST] <|end|>\n<|assistant|>\n\\<|\\\\ <\\| \\"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", "again"),
            (2, 0, "user", "no reply"), (None, 0, "assistant", "lone"), (3, None, None, "x"), (-1, 0, "us<|er", "odd role"), (4, 1, "assistant", "b"), (4, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' as place", "'y' as segment")
    made = chat.segments(df)
    expanded = chat.examples(made)
    got = {r.conv_id: r for r in chat.digest(made, expanded).collect()}
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: ((r[1] is not None, r[1]), r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        r, replies = got[c], [t for role, t in turns if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.n_examples) == (sum(map(len, replies)), brute.sha("".join(replies)), len(replies))
    texts = {(r.conv_id, r.example): r for r in chat.render(expanded, made).collect()}
    assert len(texts) == expanded.count() == 6
    whole = texts[1, 2]
    assert chat.unescape(whole.text[whole.loss_start:whole.loss_stop]) == odd and whole.text.startswith("<|system|>\nbe kind<|end|>\n<|user|>\n")
    assert whole.text.count("<|") == 6 and texts[4, 1].text.startswith("<|assistant|>\na<|end|>")
    none = chat.segments(df.where("false"))
    assert chat.digest(none, chat.examples(none)).count() == 0


def test_licenses_in_usual_forms(spark):
    texts = dict(licenses.known_texts())
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Unlicense", "Zlib", "CC0-1.0"} <= set(texts)
    stock = ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"], *texts.values()]
    lines = {"SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "Licensed under the MIT License": "MIT",
             "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "// Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Released under the MIT Licenses": ""}
    df = spark.createDataFrame(list(enumerate([*stock, *lines])), "doc_id bigint, text string")
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(df).collect()}
    assert [found[k][0] for k in range(len(stock))] == ["MIT", *texts]
    assert [found[len(stock) + k][1] for k in range(len(lines))] == list(lines.values())


@pytest.mark.parametrize("width", [13, 30, 50, 60, 72, 80, 100])
def test_licenses_wrapped(spark, width):
    # Statements inside a licence, such as its samples, keep their line.
    stated = re.compile(r"(?i)copyright\s*(\(c\)|\[|\d)")
    texts = dict(licenses.known_texts())
    rows = [(k, line) for k, text in texts.items() for line in ["Copyright 2020 Someone\nCopyright The Foo Authors\n(c) 2021 A\n© B\n" + "\n".join(
        own if stated.search(own) else textwrap.fill(own, width, break_long_words=False, break_on_hyphens=False)
        for own in text.splitlines())]]
    rows += [(k, textwrap.fill(" ".join(licenses.TEXTS[k].split()), n, break_long_words=False)) for k in licenses.TEXTS for n in range(width, width + 12)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.text) for r in df.join(licenses.known(spark, licenses.known_texts()), licenses.digest(licenses.canonical(df.text)) == F.col("digest"), "left")
           .where("not array_contains(split(names, ','), doc_id) or names is null").collect()}
    assert not got
