"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node around it.

    Only a minimum per node is aggregated (before the shuffle, too) and joined
    back: no neighbour list is ever held in one row, and a node with very many
    neighbours is a skewed join that adaptive execution can split.
    """
    ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if both_ways:
        ways = ways.union(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("low"))
    linked = ways.join(least, F.col("u") == F.col("node"))
    if both_ways:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("low").alias("b")).union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = checkpointed(_stars(_stars(edges, True), False))
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
