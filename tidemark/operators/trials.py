"""The trial ledger: every book run, kept as its return series in an append-only Parquet table.

Recording a key again replaces it for readers; recording identical returns
writes nothing. rows are (key, name, kind, params, digest, t, r float, commit, recorded).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import week_end

# Trial kinds; a check is kept but never counted as a trial.
KINDS = ("primary", "exploratory", "registered", "check")
COUNTED = KINDS[:3]


def keyed(books: DataFrame, kind: str = "exploratory", commit: str = "") -> DataFrame:
    """books (book_id, t, r[, params map]) as ledger rows without recorded; the digest is over stamps and float returns."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    live = books.filter(F.col("r").isNotNull()).withColumn("r", F.col("r").cast("float"))
    params = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params")))) if "params" in books.columns else F.lit("{}")
    live = live.withColumn("params", params).withColumn("key", F.concat_ws(" ", F.col("book_id").cast("string"),
                                                                          F.when(F.col("params") != "{}", F.col("params"))))
    # A book's periods are bounded by the calendar, so the digest's array is too.
    d = live.groupBy("key").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("t", "r")))), 256).alias("digest"))
    return (live.join(d, "key").select("key", F.col("book_id").cast("string").alias("name"), F.lit(kind).alias("kind"), "params",
                                       "digest", "t", "r", F.lit(commit).alias("commit")))


def latest(rows: DataFrame) -> DataFrame:
    """Rows of each key's latest recording."""
    last = rows.groupBy("key").agg(F.max("recorded").alias("__last"))
    return rows.join(last, "key").filter(F.col("recorded") == F.col("__last")).drop("__last")


def unseen(new: DataFrame, rows: DataFrame | None) -> DataFrame:
    """The new ledger rows whose key is unknown or whose latest digest differs."""
    if rows is None:
        return new
    known = latest(rows).select("key", "digest").distinct()
    return new.join(known, ["key", "digest"], "left_anti")


def record(books: DataFrame, path: str, recorded: Column | None = None, kind: str = "exploratory", commit: str = "") -> None:
    """Appends the changed trials to the ledger at path."""
    spark = books.sparkSession
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # a ledger not written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = None
    new = unseen(keyed(books, kind, commit), rows)
    (new.withColumn("recorded", recorded if recorded is not None else F.current_timestamp())
     .write.mode("append").option("compression", "zstd").parquet(path))


def table(rows: DataFrame) -> DataFrame:
    """One row per trial: name, kind, params, digest, span and length."""
    return latest(rows).groupBy("key").agg(
        F.any_value("name").alias("name"), F.any_value("kind").alias("kind"), F.any_value("params").alias("params"),
        F.any_value("digest").alias("digest"), F.min("t").alias("first"), F.max("t").alias("last"), F.count("r").alias("periods"))


def frame(rows: DataFrame, kinds: Sequence[str] = COUNTED, every: str | None = None) -> DataFrame:
    """(book_id, t, r) of every trial of the given kinds, summed onto weeks ending on every when given."""
    live = latest(rows).filter(F.col("kind").isin(*kinds)).select(F.col("key").alias("book_id"), "t", F.col("r").cast("double").alias("r"))
    if every is None:
        return live
    return live.groupBy("book_id", week_end("t", every).alias("t")).agg(F.sum("r").alias("r"))


def wide(frame_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods by trials for display, for the named trials only, so the width is the caller's."""
    return frame_.filter(F.col("book_id").isin(*keys)).groupBy("t").pivot("book_id", list(keys)).agg(F.last("r"))
