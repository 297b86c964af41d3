"""The pipeline's stages, and all of it, against brute force; and what is registered."""
import corpus_pipeline

import __spark_entry__
from tidemark.llm import quality

from . import brute


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def expected_quality(rows, judged):
    good = {(r.doc_id, r.n_words, r.word_chars): r.good for r in judged.collect()}
    out = []
    for d, t in rows:
        m = brute.measures(t)
        if m[0] >= 50 and 100 * m[4] <= 50 * m[0] and good[d, m[0], m[1]]:
            out.append((d, t))
    return out


def test_stages_follow_brute_force(spark, odd_docs, odd_rows, words, tmp_path):
    passage = words(50, 2)
    items = [(1, " ".join(words(30_000, 3)[700:716])), (2, " ".join(words(63, 53)[10:30])), (None, " ".join(passage))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, rows, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), odd_rows, None
    for name, stage in corpus_pipeline.STAGES:
        before, got = docs, stage(spark, docs, str(tmp_path))
        if name == "quality_rules":
            rows = expected_quality(rows, quality.judge(before))
        elif name == "near_dedup":
            rows = brute.one_of_each(rows)
        elif name == "substring_dedup":
            rows = [(d, kept if gone else t) for (d, t), (_, n, gone, kept) in zip(rows, brute.repeats(rows, 35)) if not gone or gone < n]
        elif name == "decontamination":
            rows = [r for r, (*_, bad) in zip(rows, brute.contamination(rows, items)) if not bad]
        if name != "best_fit_packing":
            assert got.columns == before.columns
            assert sort(rows_of(got)) == sort(rows), name
            got.write.parquet(f"{tmp_path}/{name}.parquet")
            docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    assert sort({(r.doc_id,) for r in got.collect()}) == sort({(d,) for d, _ in rows})
    whole = corpus_pipeline.run(spark, str(tmp_path))
    piece = lambda df: sort((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert piece(whole) == piece(got)


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]


def test_near_dedup_leaves_one_row_of_each_group(spark, words, tmp_path):
    base, other, third = words(120, 901), words(130, 902), words(140, 903)
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    join = " ".join
    rows = [(7, join(base)), (7, join(base)), (7, near(base)), (8, join(base)), (None, join(base)),  # one group
            (None, join(other)), (None, join(other)), (None, near(other)),  # one without ids
            (7, join(third)), (9, near(third)),  # another under the same id
            (3, join(words(80, 904))), (None, join(words(90, 905))), (None, None), (None, None), (4, "")]
    spark.createDataFrame(rows * 40, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, str(tmp_path)))
    groups = [{join(base), near(base)}, {join(other), near(other)}, {join(third), near(third)}, {join(words(80, 904))}, {join(words(90, 905))}]
    assert [sum(t in g for _, t in got) for g in groups] == [1] * 5
    assert sorted(d for d, t in got if t and d is not None) == [3, 7, 7]
    assert [(d, t) for d, t in got if not t].count((None, None)) == 80 and (4, "") in got
    # A clean document that stands there several times stays in the corpus.
    left = rows_of(corpus_pipeline.substring_dedup(spark, spark.createDataFrame([r for r in got if r[1]], "doc_id bigint, text string"), str(tmp_path)))
    assert len(left) == 5
