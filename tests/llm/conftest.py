import random

import pytest

CLASHING = ("row_key", "unit", "rest", "range", "keys", "node", "class", "tokens", "sketch", "cluster", "blocks", "block", "place", "part", "pool", "deal", "train", "count")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 1000 + i).choice(vocabulary) for i in range(n)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, one very long text, copies, near copies, shared passages, one id twice, rows repeated in full."""
    base, passage = words(120, 1), words(50, 2)
    near = list(base)
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t \x0b"), (4, "One"), (5, "one two"), (6, " ".join(words(30_000, 3))), (None, " ".join(base)), (7, " ".join(base)),
            (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base).upper()), (10, " ".join(words(20, 4) + passage + words(20, 5))),
            (11, "\n".join(words(10, 6)) + "\n" + " ".join(passage)), (12, "\n".join(["same line here"] * 40)), (13, " ".join(passage + passage)),
            (14, "x " * 3 + "ÀÉ 日本　語 <|endoftext|>   end\x00"), (14, "another text under one id"), (None, None)]
    return rows + [(100 + i, " ".join(words(60 + i, 50 + i))) for i in range(20)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string").repartition(3)
    for c in CLASHING:
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
