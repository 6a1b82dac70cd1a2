"""Statistics of a collection from its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments
from ..schemas import ACTIVE
from .cost import Stats


def collection_statistics(rows: DataFrame, index: DataFrame | None, capacity: int, vector: str = "embedding") -> DataFrame:
    """One row: sizes, segment states, graph nodes and layers, mean degree on the lowest layer."""
    # Every column comes from one aggregation over segments, itself partial in each task.
    per = rows.groupBy("segment_id").agg(F.count_if(F.col("status") == ACTIVE).alias("active"), F.count("*").alias("records"), F.max(F.size(vector)).alias("dimension"))
    agg = per.agg(
        F.coalesce(F.sum("active"), F.lit(0)).alias("collection_size"),
        F.coalesce(F.sum(F.col("records") - F.col("active")), F.lit(0)).alias("deleted"),
        F.coalesce(F.max("dimension"), F.lit(0)).cast("long").alias("dimension"),
        F.count_if(F.col("records") >= capacity).alias("sealed_segments"),
        F.count_if(F.col("records") < capacity).alias("growing_segments"),
    )
    if index is None:
        return agg.select("*", F.lit(0).cast("long").alias("graph_nodes"), F.lit(0).cast("long").alias("graph_layers"), F.lit(16.0).alias("average_degree"))
    graph = index.agg(F.count("*").alias("graph_nodes"), F.coalesce(F.max("level") + 1, F.lit(0)).cast("long").alias("graph_layers"), F.coalesce(F.avg(F.size(F.get("neighbors", F.lit(0)))), F.lit(16.0)).alias("average_degree"))
    return agg.crossJoin(graph)  # one row each


def snapshot(rows: DataFrame, index: DataFrame | None, capacity: int, vector: str = "embedding", cache_hits: int = 0, cache_misses: int = 0) -> Stats:
    r = collection_statistics(rows, index, capacity, vector).first()
    return Stats(r["collection_size"], r["deleted"], r["dimension"], r["sealed_segments"], r["growing_segments"], r["graph_nodes"], r["graph_layers"], max(1, round(r["average_degree"])), cache_hits, cache_misses)


def segment_stats(rows: DataFrame, capacity: int) -> DataFrame:
    return segments.stats(rows, capacity)
