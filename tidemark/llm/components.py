"""Connected components of an edge table, by alternating stars; nothing but counts reaches the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point at its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component. Loops and repeats are allowed."""
    down = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    now, before = settle(down(edges)), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = settle(down(_small_star(down(_large_star(now)))))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct()).union(loops.join(stars, "node", "left_anti")
                                                                                           .join(stars.select(F.col("root").alias("node")), "node", "left_anti"))
