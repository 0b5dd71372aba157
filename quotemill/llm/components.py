"""Connected components of a table of links, by alternating large and small stars, each two hash joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: greater neighbours of a node go to its least one. Small star: the others and the node itself do."""
    near = _both_ways(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = near.join(least, F.col("a") == F.col("node"))
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its least node. ``links``: (a, b)."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    while True:
        links = materialize(_star(_star(links, True), False), "stars")
        found = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state:
            break
        state = found
    heads = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
