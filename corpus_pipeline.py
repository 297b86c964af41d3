"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. Rows of the input are told apart by doc_id and text.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, near, packing, quality, substrings
from tidemark.session import settle


SPREAD = 64


def row_key():
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs but for the rows of a table of (doc_id, row_key)."""
    gone = rows.select(F.col("doc_id").alias("__gone_id"), F.col("row_key").alias("__gone_key")).distinct()
    return docs.join(gone, (row_key() == F.col("__gone_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__gone_id")), "left_anti")


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of docs for each of a table of (doc_id, row_key). Copies first meet by SPREAD, so a row that fills the corpus is no single task."""
    wanted = rows.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__part"))
    dealt = docs.select("*", F.col("doc_id").cast("bigint").alias("__own_id"), row_key().alias("__own_key"), F.pmod(F.spark_partition_id(), F.lit(SPREAD)).alias("__own_part"))
    match = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")) & (F.col("__own_part") == F.col("__part"))
    some = dealt.join(wanted, match, "left_semi").dropDuplicates(["__own_id", "__own_key", "__own_part"])
    return some.dropDuplicates(["__own_id", "__own_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the label model rejects."""
    judged = quality.judge(docs)
    return without(docs, judged.where(quality.base_failed() | ~F.col("good")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id, and the least row_key under it; of rows equal in both, any one."""
    extra = settle(near.surplus(docs))
    left, again = without(docs, extra), extra.where("again")
    return left if again.isEmpty() else left.unionByName(one_of_each(docs, again))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; one of which nothing is left goes. n_chars follows."""
    left = substrings.remove(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which training sequence."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination),
          ("best_fit_packing", pack)]
#: Weak supervision, exact similarity over full sets and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
