"""Connected components of a graph of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: the edges are stars around the least nodes."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 0))).isEmpty()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the least node that is reachable.

    Each round is two aggregations and two joins on the node, written to the shared folder; a node with
    very many links is pre-aggregated, and its rows can be split by an adaptive skew join.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(links.where(F.col("a") != F.col("b")).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, old = cut(small.where(F.col("u") != F.col("v")).distinct(), "edges"), edges
        release(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct().toDF("node", "component"))
