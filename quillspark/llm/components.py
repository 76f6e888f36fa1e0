"""Connected components by alternating large and small stars, on DataFrames of 64-bit nodes.

Each round is an aggregation with map-side combine and an equi-join; its edges are written to the shared folder, so a
lost executor costs one round at most. It ends when the edges are proven to be stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # all neighbours; larger ones are linked to the least of all
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # smaller neighbours; they and the node itself are linked to the least
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    least = materialize(least, "least")  # by itself, so that the join has its own exchange and a hub's edges can be split
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _apart(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two neighbours below it, or one below and one above."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v) but the roots; a root is its component's least node."""
    edges = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _apart(edges):
        old, edges = edges, materialize(_star(_star(edges, large=True), large=False), "edges")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
