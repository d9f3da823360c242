"""Connected components of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import cut_lineage, drop_frames


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours under the smallest: those above a node (large), or a node and those below it (small)."""
    pairs = _both_ways(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    if large:
        return pairs.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    hung = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return hung.filter("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a node hangs under several others, or under one that hangs itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
    return not held.filter("under > 1 or (under = 1 and over = 1)").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs) -> ``u, v``: each node with a link that reaches a smaller one, and the smallest that links reach.

    Large-star and small-star steps until every node hangs under one that hangs under none; the number of steps
    grows with the logarithm of the longest chain. Every step works on mergeable minima and joins, and is written
    before the next, so that steps over few links read few files and not every partition of a shuffle.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    # links hang from the larger end, as small stars leave them
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    while _open(edges):
        large = cut_lineage(_star(edges, True), "edges")
        small = cut_lineage(_star(large, False), "edges")
        drop_frames(edges, large)
        edges = small
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs) -> ``node, component``: the smallest node that links reach, for each node with a link."""
    edges = stars(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
