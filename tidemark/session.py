"""Session settings and the shared scratch area."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Windows are CPU-heavy per row, so small shuffles keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine's settings; master and anything else come from the caller or spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a new temporary folder on a local master, as in tests; a cluster's
    executors would each write to a disk of their own, so there it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Deletes the stored copies of this session; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{_session(spark)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _session(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back.

    Cuts the lineage of a frame that a plan reads several times, so its source is
    scanned once. The copy outlives lost executors, and its file statistics let
    the optimizer decide on broadcasting by real size. clear removes the copies.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{_session(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
