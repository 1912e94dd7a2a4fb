"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, joined_apart


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return joined_apart(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = joined_apart(edges, least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge.

    Large-star and small-star steps alternate until the edges form stars.
    Minima are partial before their shuffle, and they are joined back on another
    expression than they were grouped by, so that Spark can split a hot node: no
    task needs all edges of one node.  Each step's edges are written, so that a
    lost executor repeats one step at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sign = before = None
    while True:
        kept = scratch.keep(_small_star(_large_star(edges)), "edges")
        now = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(before)
        edges = before = kept
        if now == sign:
            break
        sign = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
