"""Distributed union-find: connected components of links between 64-bit ids.

Two alternating rewrites, large-star and small-star, turn any graph into stars
whose centre is the smallest id of the component.  Each is a grouped minimum
(summed before the shuffle) and an equi-join (large partitions of which Spark
splits), so no component and no list of neighbours has to fit in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import remove, written


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each of ``n`` nodes' component, after the links a-b join ``root``."""
    root = np.arange(n) if root is None else root
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a and b, long), root the smallest id.

    Nodes without links do not appear; a null end or a link from a node to
    itself is no link.  No edges give an empty result.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select("a", "b"), "edges")
    mark = None
    while True:
        after, new = written(_small_star(_large_star(now)), "edges")
        remove(spark, path)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, path = after, new
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
