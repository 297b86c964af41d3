"""Chat formatting by prefix-target expansion.

A conversation becomes one formatted text of marked turns, each turn also being a
prefix's end. Every assistant turn is an example of its own: all turns before it are
its context and only its reply is trainable. Since that context is always a prefix
of the conversation's text, an example is stored as where its context stops and
where its reply starts and stops: examples grow with the turns, not with their
square, however long a conversation is; `render` puts the text of chosen examples
together.

Template: `<|role|>` and a line feed, the text, `<|end|>` and a line feed. In roles
and texts the escape `\\` becomes `\\\\`, and `<|` becomes `<\\|`, so no text can
hold a control string and `unescape` gives it back.

Rows are ordered by turn, those of one turn by role and text. A null text or role is
empty, rows without conv_id are one conversation. A conversation without an
assistant turn has no example but stands among the segments. Empty tables give empty
results; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

ASSISTANT = "assistant"
OPEN, HEAD, CLOSE = "<|", "|>\n", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += (text[at:k], "\\" if text[k + 1] == "\\" else "")
        at = k + 2 if text[k + 1] == "\\" else k + 1
    return "".join([*out, text[at:]])


def segments(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, place (0, 1, ... in the conversation), role, segment (its formatted text), start and stop in the formatted
    conversation, head (the characters before its text)."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD))
    rows = rows.select("*", F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("segment"), F.length(head).cast("bigint").alias("head"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", (F.row_number().over(w) - 1).alias("place"), F.sum(F.length("segment")).over(running).alias("stop"))
    out = out.withColumn("start", F.col("stop") - F.length("segment"))
    return out.select("conv_id", "place", "role", "segment", "start", "stop", "head")


def examples(made: DataFrame, role: str = ASSISTANT) -> DataFrame:
    """One row for each assistant turn: conv_id, example (its place), context_stop (the context is the conversation's text before it), and the trainable
    span loss_start to loss_stop, the reply alone."""
    return made.where(F.col("role") == role).select("conv_id", F.col("place").alias("example"), F.col("start").alias("context_stop"),
                                                    (F.col("start") + F.col("head")).alias("loss_start"), (F.col("stop") - len(CLOSE)).alias("loss_stop"))


def render(chosen: DataFrame, made: DataFrame) -> DataFrame:
    """The texts of chosen examples, context and reply, with the trainable span. For examples that a batch holds, not for all at once."""
    own = chosen.alias("e").join(made.alias("s"), F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("s.place") <= F.col("e.example")))
    whole = own.groupBy("e.conv_id", "e.example", "e.loss_start", "e.loss_stop").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s.place", "s.segment"))), lambda x: x.segment), "").alias("text"))
    return whole.select("conv_id", "example", "text", "loss_start", F.least("loss_stop", F.length("text")).alias("loss_stop"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns and replies read back from the formatted segments, conversation by conversation; what is held is one turn and two digests."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
    now, state = None, None
    done = lambda: {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(),
                    "formatted_chars": state[4], "n_examples": state[5]}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now != (r["conv_id"],):
                if now:
                    out.append(done())
                now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, _, text = r["segment"][len(OPEN):-len(CLOSE)].partition(HEAD)
            state[0] += 1
            state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            state[4] += len(r["segment"])
            if r["loss_start"] is not None:
                reply = unescape(r["segment"][r["loss_start"] - r["start"]:r["loss_stop"] - r["start"]])
                state[2] += len(reply)
                state[3].update(reply.encode())
                state[5] += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([done()], schema)


def digest(made: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per conversation what its segments and examples say when read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    e = expanded.select(F.col("conv_id").alias("own"), "example", "loss_start", "loss_stop")
    rows = made.join(e, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("place") == F.col("example")), "left")
    rows = rows.select("conv_id", "place", "segment", "start", "loss_start", "loss_stop")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(
        _digested, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint")
