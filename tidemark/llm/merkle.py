"""A Merkle manifest of a table: every row's digest, a witness for it, and one root over all.

A row is a leaf. Leaves of a group ascend by a key and are hashed in runs of FAN,
level by level, up to the group's root; the groups' roots, in order, make the
table's root the same way. `Tree` takes nodes one after another and keeps, for
each node of a run that is still open, a partial witness: the siblings so far.
Each later sibling extends them, and a full run becomes a further append a level
higher, so nothing is read twice. Spark cuts a group into aligned blocks of
BLOCK leaves, each a tree of its own in some task; the roots of blocks are then
appended to the tree above as any other nodes, block by block again, until one
root remains.

Rows with a null key come first; equal keys follow their digests, and rows equal in
all columns take places beside each other, each with its own witness. A null group is a
group, the first. A table without rows has no root and no rows in the manifest.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

FAN, HEIGHT = 8, 4
BLOCK = FAN ** HEIGHT
PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(eq=False)
class Node:
    """A node and its witness in its run: the siblings before it, known when it comes, and those after, as far as they have come."""
    digest: str
    before: str
    after: list[str] = field(default_factory=list)
    parent: "Node | None" = None
    shared: "list[tuple[str, str]] | None" = None

    def path(self) -> list[tuple[str, str]]:
        """The siblings (before, after) level by level, as far up as runs are complete."""
        return [(self.before, "".join(self.after)), *self.parent.above()] if self.parent else []

    def above(self) -> list[tuple[str, str]]:
        if self.shared is None:
            self.shared = self.path()
        return self.shared


class Tree:
    """Nodes appended in order; open[l] is the run of level l that waits for siblings."""

    def __init__(self, fan: int = FAN):
        self.fan, self.open, self.counts = fan, [], []

    def append(self, value: str, level: int = 0) -> Node:
        """The next node of a level: a leaf, or the root of an aligned block of fan**level leaves."""
        while len(self.open) <= level:
            self.open.append([])
            self.counts.append(0)
        if any(self.open[:level]):
            raise ValueError("a block can only be appended where all smaller subtrees are complete")
        run = self.open[level]
        node = Node(value, "".join(n.digest for n in run))
        for n in run:
            n.after.append(value)
        run.append(node)
        self.counts[level] += 1
        if len(run) == self.fan:
            self._complete(level)
        return node

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = self.append(digest("".join(n.digest for n in run)), level + 1)
        for n in run:
            n.parent = parent

    def close(self, height: int | None = None) -> Node:
        """Ends the tree: open runs count as complete, until one node remains, or up to a height where this is a block of a larger tree."""
        level = next(l for l, c in enumerate(self.counts) if c)
        while level != height and not (height is None and self.counts[level] == 1):
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0]


def fold(value: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a digest and its witness lead to."""
    for before, after in path:
        value = digest(before + value + after)
    return value


def leaf(columns: dict[str, Column] | Sequence[str]) -> Column:
    """A row's digest: each column as `-` where null, else its bytes counted, a colon and its text."""
    cols = columns.values() if isinstance(columns, dict) else [F.col(c) for c in columns]
    texts = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds place, from 0 in each group by order, and size, the group's rows; settled.

    Rows are dealt by ranges of (group, order, a number of their own), so a group that holds
    most rows, or rows that are all equal, spread over as many tasks as others.
    """
    rows = settle(rows.withColumn("own", F.monotonically_increasing_id()))
    by = [group, *order, "own"]
    rows = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("own", F.monotonically_increasing_id()).withColumn("task", F.shiftright("own", 33)))
    counts = rows.groupBy(F.col(group).alias("its_group"), F.col("task").alias("its_task")).agg(F.min("own").alias("first"), F.count("*").alias("held"))
    w = Window.partitionBy("its_group")
    counts = counts.withColumn("size", F.sum("held").over(w)).withColumn("earlier", F.sum("held").over(w.orderBy("its_task")) - F.col("held"))
    placed = rows.join(counts, F.col(group).eqNullSafe(F.col("its_group")) & (F.col("task") == F.col("its_task")))
    placed = placed.withColumn("place", F.col("own") - F.col("first") + F.col("earlier"))
    return settle(placed.drop("own", "task", "its_group", "its_task", "first", "held", "earlier"))


def _grown(group: pa.Table, value: str) -> tuple[list[int], dict[str, list], list[Node], Node]:
    """A block as a tree: its rows by place, and the root."""
    group = group.sort_by("place")
    cols = {c: group.column(c).to_pylist() for c in group.column_names}
    tree = Tree()
    nodes = [tree.append(v) for v in cols[value]]
    return cols["place"], cols, nodes, tree.close(HEIGHT if cols["size"][0] > BLOCK else None)


def block_roots(nodes: DataFrame) -> DataFrame:
    """(grp, place, size, value) -> the same of the blocks' roots, one level of blocks higher."""
    kind = nodes.schema["grp"].dataType.simpleString()

    def root(key, group):
        _, cols, _, top = _grown(group, "value")
        one = {"grp": group.column("grp")[:1], "place": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-cols["size"][0] // BLOCK)], pa.int64()), "value": pa.array([top.digest])}
        return pa.table({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in one.items()})
    blocks = nodes.withColumn("block", F.expr(f"place div {BLOCK}"))
    return settle(blocks.groupBy("grp", "block").applyInArrow(root, f"grp {kind}, place bigint, size bigint, value string"))


def witnesses(nodes: DataFrame) -> DataFrame:
    """(grp, place, size, value) -> (grp, place, root, path): each node's siblings up to its group's root."""
    kind = nodes.schema["grp"].dataType.simpleString()
    out = f"grp {kind}, place bigint, root string, path {PATH}"
    upper = _upper(block_roots(nodes))

    def extend(key, group, above):
        places, cols, own, _ = _grown(group, "value")
        rest, root = above.column("path")[0].as_py(), above.column("root")[0].as_py()
        paths = [[{"before": b, "after": a} for b, a in n.path()] + rest for n in own]
        return pa.table({"grp": pa.array(cols["grp"], group.schema.field("grp").type), "place": pa.array(places, pa.int64()), "root": pa.array([root] * len(places), pa.string()),
                         "path": pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})
    blocks = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("grp", "block")
    return blocks.cogroup(upper.withColumn("block", F.col("place")).groupBy("grp", "block")).applyInArrow(extend, out)


def _upper(roots: DataFrame) -> DataFrame:
    """What witnesses gives, for roots of blocks: nothing where each is its group's only one, else from the tree above."""
    if not roots.where("size > 1").isEmpty():
        return witnesses(roots)
    return roots.select("grp", "place", F.col("value").alias("root"), F.array().cast(PATH).alias("path"))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, tampered: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs.

    columns: what a leaf is made of. tampered: another digest to be verified in place of a row's
    own where not null (see leaf), against the witness of the row as it was.
    """
    rows = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf(columns).alias("value"), (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    leaves = placed(rows, "grp", ["key", "value"])
    kind, key_kind = (leaves.schema[c].dataType.simpleString() for c in ("grp", "key"))
    groups = settle(_upper(block_roots(leaves.select("grp", "place", "size", "value"))))
    tops = groups.where("place = 0").select(F.lit(0).alias("one"), F.col("grp").alias("member"), F.col("root").alias("value"))
    tops = placed(tops, "one", ["member"])
    top = witnesses(tops.select(F.lit(0).alias("grp"), "place", "size", "value")).select("place", F.col("root").alias("top"), F.col("path").alias("last"))
    top = tops.select("place", "member").join(top, "place").drop("place")
    groups = groups.join(top, F.col("grp").eqNullSafe(F.col("member"))).select("grp", F.col("place").alias("block"), "root", "top", F.concat("path", "last").alias("path"))

    def prove(key, block, above):
        _, cols, own, _ = _grown(block, "value")
        rest = [(x["before"], x["after"]) for x in above.column("path")[0].as_py()]
        tail, subroot, root = "".join(b + a for b, a in rest), above.column("root")[0].as_py(), above.column("top")[0].as_py()
        proofs, folded = [], []
        for node, seen, other in zip(own, cols["value"], cols["other"]):
            path = node.path()
            proofs.append(digest("".join(b + a for b, a in path) + tail))
            folded.append(fold(fold(other if other is not None else seen, path), rest))
        n = len(own)
        return pa.table({"key": pa.array(cols["key"], block.schema.field("key").type), "leaf": pa.array(cols["value"], pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})
    blocks = leaves.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("grp", "block")
    done = blocks.cogroup(groups.groupBy("grp", "block")).applyInArrow(prove, f"key {key_kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumnRenamed("key", key)
