"""Token ids on disk: one zstandard frame a document under a shared dictionary.

Format. A folder holds two Parquet tables, so that any store Spark writes to will
do. `dictionary` has one row: the dictionary's bytes and their sha256. `blocks`
has a row for each few MB of text: its part and its place in the part, which give
the order of documents; the dictionary's sha256; width, the bytes of an id (2 or
4, little-endian); and for its documents the ids doc_ids, the counts n_tokens and
the offset index ends, where each frame of payload stops. One document is read by
its frame alone, see `fetch`.

The dictionary is trained on the serialized ids of a sample of at most SAMPLE
texts of at most 64 KB; it only serves compression. With too few texts to train on
it is empty. Documents stand in ascending doc_id, nulls first, equal ids by a hash
of their text. A null text is empty: only its end id. Extra columns are ignored;
an empty table gives an empty folder of blocks.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .encode import shared
from .words import column, parts, texts

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, PART_BYTES = 1000, 1 << 16, 1 << 15, 32 << 20
BLOCKS = "part int, place int, dictionary string, width int, doc_ids array<bigint>, n_tokens array<bigint>, ends array<bigint>, payload binary"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data), write_checksum=False, write_dict_id=False)


def train(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """A dictionary from a bounded sample of texts."""
    n = docs.select(F.lit(1)).count()
    share = min(1.0, 20 * SAMPLE / max(n, 1))
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).sample(share, seed=9).limit(SAMPLE).select("text").collect()
    encoder, samples = shared(path), []
    for r in rows:
        buf = np.frombuffer(r.text.encode(), np.uint8)
        samples.append(np.append(encoder.encode(buf, np.array([0, len(buf)]))[0], end).astype(f"<u{width}").tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # the library's answer to too few or too small samples
        return b""


def _writer(path: str, end: int, width: int, dictionary: bytes):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress, part, place = shared(path), _compressor(dictionary).compress, TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, offsets = column(batch.column("text"))
            for a, b in parts(offsets):
                ids, counts = encoder.encode(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype(f"<u{width}")
                edge = np.concatenate([[0], np.cumsum(counts + 1)])
                frames = [compress(ids[i:j].tobytes()) for i, j in zip(edge, edge[1:])]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([digest]), pa.array([width], pa.int32()),
                     one(batch.column("doc_id").slice(a, b - a)), one(pa.array(counts + 1)), one(pa.array(np.cumsum([len(f) for f in frames], dtype=np.int64))),
                     pa.array([b"".join(frames)], pa.binary())],
                    names=["part", "place", "dictionary", "width", "doc_ids", "n_tokens", "ends", "payload"])
                place += 1
    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> None:
    """Every text's ids and the end id into folder, in ascending doc_id."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    docs = texts(docs)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    dictionary = train(docs, tokenizer, end, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dictionary string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    # A hash of the text as well, so that rows under one id can be dealt to several parts.
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_writer(tokenizer, end, width, dictionary), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def decode(row: dict, dictionary: bytes, which: list[int] | None = None) -> list[np.ndarray]:
    """The ids of a block's documents, or of some, reading only their frames."""
    if hashlib.sha256(dictionary).hexdigest() != row["dictionary"]:
        raise ValueError("the block was written with another dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    ends = [0, *row["ends"]]
    return [np.frombuffer(reader.decompress(row["payload"][ends[k]:ends[k + 1]]), f"<u{row['width']}") for k in (range(len(ends) - 1) if which is None else which)]


def load_dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["data"])


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as uint32, and with ids the ids."""
    dictionary, blocks = load_dictionary(spark, folder), spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, row in enumerate(batch.select(["dictionary", "width", "ends", "payload", "part", "place"]).to_pylist()):
                own = [x.astype("<u4") for x in decode(row, dictionary)]
                n = np.array([len(x) for x in own], np.int64)
                out = [batch.column("doc_ids")[r].values, pa.array(np.full(len(n), row["part"], np.int32)), pa.array(np.full(len(n), row["place"], np.int32)),
                       pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "part", "place", "within", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    more = ", ids array<bigint>" * ids
    rows = blocks.mapInArrow(run, "doc_id bigint, part int, place int, within bigint, n_tokens bigint, ids_crc32 bigint" + more)
    # Where blocks start: running sums inside each part, and over the parts, of which there are a few for each GB.
    sizes = blocks.select("part", "place", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n"))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before("part").alias("part_start"))
    starts = sizes.select("part", "place", before("part", "place").alias("block_start")).join(whole, "part")
    out = rows.join(starts, ["part", "place"]).withColumn("start", F.col("part_start") + F.col("block_start") + F.col("within"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, from its own frame; more than one if rows share the id."""
    dictionary, out = load_dictionary(spark, folder), []
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
    for row in blocks.orderBy("part", "place").toLocalIterator():
        out += decode(row.asDict(), dictionary, [k for k, d in enumerate(row.doc_ids) if d == doc_id])
    return out


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
