"""Connected components of a table of edges, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.storage import discard, materialize

#: A node is busy above this many neighbours, or above this share of all edges if that is more.
BUSY, SHARE = 4096, 5000


def _tie(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``edges(a, b)`` with the ``low`` of a.

    The edges of a busy node stay where they are and its row comes to them; as it has
    more than the limit, at most ``2 * SHARE`` such rows exist.
    """
    busy = F.broadcast(least.where(F.col("degree") > limit).select("a", "low"))
    others = edges.join(busy, "a", "left_anti").join(least.where(F.col("degree") <= limit).select("a", "low"), "a")
    return edges.join(busy, "a").select("a", "b", "low").unionByName(others.select("a", "b", "low"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; a component is named by its least node.

    Alternates two star steps until nothing changes: every node's larger
    neighbours are tied to its least neighbour, then every node's smaller ones
    are.  Rounds grow with the logarithm of the longest path and aren't limited.
    Both steps aggregate before they shuffle, and a node with any number of
    neighbours is spread over tasks; each round's edges are written to the shared
    folder.  A null end makes no edge; loops only name their node.
    """
    clean = edges.where("a is not null and b is not null")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select(F.col("b").alias("node"))).distinct()
    now = materialize(clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    changed = True
    while changed:
        limit = max(BUSY, now.count() // SHARE)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("degree"))
        large = _tie(both.where("b > a"), least, limit).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("degree"))
        small = _tie(large, low, limit).select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        new = materialize(small, "components")
        changed = bool(new.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(new, ["a", "b"], "left_anti").limit(1).count())
        discard(now)
        now = new
    root = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
