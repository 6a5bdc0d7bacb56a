"""Connected components of a table of links, by alternating large and small stars; nothing gathers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours above it (large) or not above it (small, with itself) move to its least neighbour."""
    both = edges.select("a", "b").union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long): the least node that it reaches."""
    now = scratch.keep(edges.select("a", "b").where("a != b").distinct())
    mark = None
    while True:
        now = scratch.keep(_star(_star(now, True), False))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    pairs = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
