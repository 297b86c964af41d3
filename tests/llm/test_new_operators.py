"""Manifest, whitening and line classifier against brute force."""
import hashlib
import itertools
import math
import pickle
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_quality as Q, merkle, queries, whitening as W

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def climb(nodes):
    """Root of a list of digests, and each one's siblings level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 8 * 8
            p.append(("".join(level[run:at[k]]), "".join(level[at[k] + 1:run + 8])))
        level, at = [H("".join(level[i:i + 8])) for i in range(0, len(level), 8)], [a // 8 for a in at]
    return level[0], paths


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def expected_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> rows of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]),) for g in names}
    trees = {g: (x[0], *climb([y[2] for y in x[0]])) for g, x in trees.items()}
    root, tops = climb([trees[g][1] for g in names])
    out = []
    for g, top in zip(names, tops):
        members, subroot, paths = trees[g]
        for (*_, own, r), path in zip(members, paths):
            path, seen = path + top, own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                seen = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                seen = H(before + seen + after)
            out.append((r[0], own, subroot, root, H("".join(b + a for b, a in path)), seen, seen == root))
    return sorted(out, key=str)


def run_manifest(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    for c in ("grp", "place", "size", "own", "task", "path", "root", "value", "other", "block", "key", "member"):
        df = df.withColumn(c, F.lit(c))
    df.repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


def test_manifest(spark, odd_rows, tmp_path):
    langs = [None, "", "en", "é", "z", "日"]
    rows = [(d, None if k % 7 == 3 else f"s{k % 3}", langs[k % 6], None if t is None else len(t), t) for k, (d, t) in enumerate(odd_rows)]
    rows += [rows[7]] * 20 + [(k, "S", "de", k, f"Text {k}") for k in range(75)] + [(5, "S", f"l{k}", 1, "Q") for k in range(9)]
    assert run_manifest(spark, rows, tmp_path / "a") == expected_manifest(rows)
    assert run_manifest(spark, rows[:1], tmp_path / "b") == expected_manifest(rows[:1])
    assert run_manifest(spark, [], tmp_path / "c") == []


def test_manifest_over_several_blocks(spark, tmp_path):
    # A third of the rows are one row, repeated; the group needs three blocks, the last of them of one leaf.
    rows = [(7, "s", "en", 4, "Same")] * 3000 + [(k, "s", "en", k, f"T{k}") for k in range(2 * merkle.BLOCK + 1 - 3000)] + [(k, None, "fr", 1, "x") for k in range(merkle.BLOCK)]
    got = run_manifest(spark, rows, tmp_path)
    assert got == expected_manifest(rows) and sum(not r[-1] for r in got) > 2000


def test_witnesses_grow_with_appends():
    leaves = [H(str(k)) for k in range(101)]
    tree, nodes = merkle.Tree(), []
    for k, v in enumerate(leaves):
        nodes.append(tree.append(v))
        assert nodes[-1].before == "".join(leaves[k // 8 * 8:k])
        if k == 50:
            # A tree can rest between two deliveries; witnesses so far keep growing after it.
            tree, nodes = pickle.loads(pickle.dumps((tree, nodes)))
            assert "".join(nodes[48].after) == leaves[49] + leaves[50] and nodes[48].parent is None and nodes[40].parent is not None
    root, paths = climb(leaves)
    assert tree.close().digest == root and [n.path() for n in nodes] == paths
    assert {merkle.fold(v, n.path()) for v, n in zip(leaves, nodes)} == {root}
    # Aligned blocks, each a tree of its own, append their roots.
    whole = merkle.Tree()
    for at in range(0, 101, 64):
        block = merkle.Tree()
        for v in leaves[at:at + 64]:
            block.append(v)
        whole.append(block.close(2).digest, level=2)
    assert whole.close().digest == root
    with pytest.raises(ValueError):
        odd = merkle.Tree()
        odd.append(leaves[0])
        odd.append(leaves[1], level=1)


def table_of(spark, vectors):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for c in ("component", "n", "deviation", "whitened", "at", "dims", "cell", "rank"):
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


def expected_whitening(vectors, most=8):
    """By exact sums and numpy's eigenvectors."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    e, v = np.linalg.eigh((off.T @ off).astype(float) / float(n) ** 3)
    k = min(most, int((e > e[-1] * 1e-10).sum()))
    white = (off.astype(float) / n) @ v[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])
    return [int(d) for d in (off * off).sum(1)], white, e[::-1][:k] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.1, 1, 12)).tolist()
    good += [good[0]] * 60
    bad = [None, [], [None] * 12, [1.0] * 11, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [1e306] + [0.0] * 11, [0.5] * 13, [0.5] * 13]
    got = W.whiten(table_of(spark, good + bad), "vec_id", "embedding").collect()
    assert {r.vec_id for r in got} == set(range(len(good))) and len(got) == 8 * len(good)
    deviation, white, explained = expected_whitening(good)
    mine = np.zeros((len(good), 8))
    for r in got:
        assert r.deviation == deviation[r.vec_id] and r.n == len(good) and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        mine[r.vec_id, r.component - 1] = r.whitened
    for k in range(8):
        sign = np.sign(mine[:, k] @ white[:, k])
        assert np.abs(mine[:, k] - sign * white[:, k]).max() < 1e-8


def test_whitening_of_few_flat_equal_and_huge_vectors(spark):
    run = lambda v: W.whiten(table_of(spark, v), "vec_id", "embedding").collect()
    assert run([]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 9) == [] and run([None, [float("nan")]]) == []
    line = run([[k, 2 * k, 0] for k in range(10)])
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    # Four directions of equal spread: any orthonormal basis will do.
    even = run([[s * (i == j) for i in range(4)] for j in range(4) for s in (1, -1)])
    assert len(even) == 32 and max(r.identity_error for r in even) < 1e-12 and {round(r.explained, 12) for r in even} == {0.25}
    huge = run([[1e13, 0.0], [-1e13, 1.0], [2e13, 5.0], [0.0, 1e-9]])
    assert len(huge) == 8 and max(r.identity_error for r in huge) < 1e-6 and {r.deviation for r in huge} == {None}


def test_polynomial_and_roots(spark):
    m = [[2, 1, 0], [1, 2, 1], [0, 1, 2]]
    poly = W.polynomial(spark, m)
    assert poly == [-4, 10, -6, 1]
    assert [W.above(poly, a) for a in (0, 1, 2, 3)] == [3, 2, 1, 1]
    value, beyond, upto = W.root(poly, 100, 1)
    assert abs(Fraction(value, 1 << 100) - Fraction(2 + math.sqrt(2))) < 1e-12 and (beyond, upto) == (0, 1)
    assert W.root(W.polynomial(spark, [[1, 1], [1, 1]]), 10, 2) is None


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    lines = np.array([1, 4, 2, 5])
    codes = np.stack([rng.integers(0, b, lines.sum()) for b in Q.BINS], axis=1).astype(np.uint8)
    c = Q.Chains(lines, codes.ravel())
    x = rng.normal(size=Q.WEIGHTS + 4) * 0.7
    w, t, y = x[:Q.WEIGHTS], x[Q.WEIGHTS:].reshape(2, 2), np.array([1, 0, 1, 0])
    s = c.emissions(w)
    good, fit, moved, of_line = c.marginals(s, t, y)
    want, likely, at = [], 0.0, 0
    for n, label in zip(lines, y):
        weight = {p: math.exp(sum(s[at + i] for i in range(n) if p[i]) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        want += [sum(v for p, v in weight.items() if p[i]) / z for i in range(n)]
        likely += math.log(weight[(label,) * n] / z)
        at += n
    assert np.allclose(good, want) and fit == pytest.approx(likely) and np.allclose(c.marginals(s, t), want)
    g = np.concatenate([c.spread(of_line - good), moved.ravel()])
    value = lambda z: c.marginals(c.emissions(z[:Q.WEIGHTS]), z[Q.WEIGHTS:].reshape(2, 2), y)[1]
    for k in [*rng.choice(Q.WEIGHTS, 25, replace=False), *range(Q.WEIGHTS - 3, Q.WEIGHTS + 4), int(codes[0, 0])]:
        step = np.zeros(len(x))
        step[k] = 1e-5
        assert (value(x + step) - value(x - step)) / 2e-5 == pytest.approx(g[k], abs=1e-5)


def test_long_chains_stay_finite():
    lines = np.array([20_000, 1])
    codes = np.zeros((20_001, len(Q.BINS)), np.uint8)
    c = Q.Chains(lines, codes.ravel())
    good, fit, *_ = c.marginals(np.full(20_001, 300.0), np.array([[9.0, -9.0], [-9.0, 9.0]]), np.array([1, 0]))
    assert np.isfinite(good).all() and good.min() > 0.99 and np.isfinite(fit)


def test_looks_of_lines():
    text = "Ab cd cd\n\nXX!! XX!! YY!!\nAb cd cd\n".encode()
    buf = np.frombuffer(text + b"one", np.uint8)
    first, chars, codes = Q.looks(buf, np.array([0, len(text), len(text), len(text) + 3]))
    assert first.tolist() == [0, 5, 6, 7] and chars.tolist() == [8, 0, 14, 8, 0, 0, 3]
    col = {k: codes[:, i].tolist() for i, k in enumerate(Q.LOOKS)}
    assert col["words"][:4] == [2, 0, 2, 2] and col["seen"] == [0, 0, 0, 1, 0, 0, 0] and col["ending"] == [3, 0, 2, 3, 0, 0, 3]
    assert col["again"][0] == np.searchsorted(Q.SHARE, 1 / 3, "right") and col["loud"][2] == 8 and col["upper"][2] == 8


def test_quality_of_odd_documents(spark, odd_docs, odd_rows, no_docs, words):
    some = lambda k: "\n".join(" ".join(words(9, 31 * k + i)) for i in range(k % 5 + 1))
    loud = lambda k: "\n".join("!! ".join(words(9, 31 * k + i)).upper() + "!!" for i in range(k % 5 + 1))
    rows = [(1000 + k, loud(k) if k % 2 else some(k)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    labels = [(1000 + k, int(k % 2 == 0), 0) for k in range(300)] + [(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 0, 0), (1000, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("label", F.lit("x"))
    learn = F.col("doc_id") % 3 != 1
    got = Q.score(docs, labels, learn).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows + odd_rows)
    held_out = {r.doc_id: r.score for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.doc_id % 3 == 1}
    assert len(held_out) == 100 and all((s >= 0.5) == (d % 2 == 0) for d, s in held_out.items()) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    none = labels.limit(0)
    assert {r.score for r in Q.score(docs, none, learn).collect()} == {0.5}
    assert {r.score for r in Q.score(docs, labels.where("quality = 1"), learn).collect()} == {1.0}
    assert Q.score(no_docs, labels, learn).collect() == []


def test_quality_scores_weigh_lines(spark, words):
    """A document's score is the mean of its lines' marginals by their length."""
    docs = spark.createDataFrame([(k, "\n".join([" ".join(words(5 + k, k)), "!! ".join(words(4, k + 50)).upper(), ""])) for k in range(12)] + [(50, None), (51, "\n\n")], "doc_id bigint, text string")
    model = np.random.default_rng(2).normal(size=Q.WEIGHTS + 4) * 0.2
    text = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    for r in Q.lines(Q.describe(docs), model).collect():
        size = [len(x) for x in text[r.doc_id]]
        size = size if sum(size) else [1] * len(size)
        assert len(r.good) == len(size) and r.score == pytest.approx(sum(a * b for a, b in zip(size, r.good)) / sum(size))
