"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's larger (or smaller) neighbours to its smallest one. The minimum is summed up per task first,
    and joined back, so that a node with very many neighbours is spread over tasks."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(low, "u").where("v > u" if large else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        tied = tied.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to (node, root): every node that has an edge, and the smallest node that it reaches.

    Each round is a written table; rounds grow with the logarithm of the number of nodes.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _state(edges)
    while now != before:
        edges = written(_stars(_stars(edges, large=True), large=False))
        before, now = now, _state(edges)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
