"""Segments: vectors in numbered groups of bounded size, with tombstones and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACTIVE


#: Ranges at the most: beyond it they grow, and a range's window sorts on disk.
MOST_RANGES = 10_000


def range_of(value: Column, cuts: list, kind: str) -> Column:
    """How many of the sorted ``cuts`` lie below the value: a binary search in one constant array."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    sorted_cuts = F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{kind}>")  # folded to a constant

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.get(sorted_cuts, middle) < value
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~above, middle).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve)["lo"]


def ordinals(rows: DataFrame, by: str, name: str = "ordinal", per_range: int = 100_000, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of a numeric, unique column, without sorting all rows in one task.

    Rows are dealt into ranges between quantiles; a range's rows are numbered by a window of their own and
    moved on by the sizes of the ranges before it (one small row per range).
    """
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, n // per_range))
    cuts: list = []
    if ranges > 1:
        shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
        cuts = sorted(set(rows.agg(F.percentile_approx(by, shares, max(10_000, 4 * ranges))).first()[0] or []))
    dealt = rows.withColumn("__range", range_of(F.col(by), cuts, dict(rows.dtypes)[by]))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))  # MOST_RANGES rows
    return dealt.withColumn("__within", within).join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__within") + F.col("__before") + start).cast("long")).drop("__range", "__within", "__before")


def assign(rows: DataFrame, by: str, capacity: int, start: int = 0) -> DataFrame:
    """``segment_id`` and ``vector_idx``: segments fill up exactly to their capacity, from ordinal ``start`` on."""
    n = ordinals(rows, by, "__ordinal", start=start)
    return n.withColumn("segment_id", F.floor(F.col("__ordinal") / capacity).cast("long")).withColumn("vector_idx", (F.col("__ordinal") % capacity).cast("long")).drop("__ordinal")


def stats(rows: DataFrame, capacity: int) -> DataFrame:
    """Counts of each segment, and its state: sealed once full, else growing."""
    n = rows.groupBy("segment_id").agg(F.count("*").alias("records"), F.count_if(F.col("status") != ACTIVE).alias("deleted"), F.count_if(F.col("status") == ACTIVE).alias("active"))
    return n.withColumn("state", F.when(F.col("records") >= capacity, "sealed").otherwise("growing"))


def should_compact(segments: DataFrame, capacity: int) -> DataFrame:
    """One row: at least two segments, and at least two under half the capacity."""
    small = F.count_if(F.col("records") < capacity // 2)
    return segments.agg(F.count("*").alias("segments"), small.alias("small")).withColumn("should_compact", (F.col("segments") >= 2) & (F.col("small") >= 2))


def eligible(segments: DataFrame, capacity: int, tombstone_share: float = 0.2) -> DataFrame:
    """Segments worth rewriting: under half full, or with many tombstones."""
    return segments.where((F.col("active") < capacity // 2) | (F.col("deleted") > tombstone_share * F.col("records")))


def compact(rows: DataFrame, capacity: int, only: DataFrame | None = None) -> DataFrame:
    """Rows of the segments ``only`` (else of all), without tombstones, in new segments of at most ``capacity``.

    Live rows keep the order of their old segment and place. Their number before a segment comes from one
    row per segment, so each segment is renumbered by itself.
    """
    from_ = rows if only is None else rows.join(only.select("segment_id"), "segment_id", "left_semi")
    live = from_.where(F.col("status") == ACTIVE)
    within = F.row_number().over(Window.partitionBy("segment_id").orderBy("vector_idx")) - 1
    sizes = live.groupBy("segment_id").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = live.withColumn("__within", within).join(sizes.select("segment_id", before.alias("__before")), "segment_id").withColumn("__n", F.col("__within") + F.col("__before"))
    moved = n.withColumnRenamed("segment_id", "old_segment_id").withColumnRenamed("vector_idx", "old_vector_idx")
    return moved.withColumn("segment_id", F.floor(F.col("__n") / capacity).cast("long")).withColumn("vector_idx", (F.col("__n") % capacity).cast("long")).drop("__n", "__within", "__before")


def lookup(rows: DataFrame, segment_id: int, vector_idx: int) -> DataFrame:
    """The row at a place; a place out of range gives none."""
    return rows.where((F.col("segment_id") == segment_id) & (F.col("vector_idx") == vector_idx))


def mark_deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Soft delete: unknown ids are ignored."""
    mark = gone.select(F.col(key).alias("__gone")).distinct()
    out = rows.join(mark, F.col(key) == F.col("__gone"), "left")
    return out.withColumn("status", F.when(F.col("__gone").isNotNull(), F.lit(2)).otherwise(F.col("status"))).drop("__gone")


def delete_cascade(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Tables documents, chunks, embeddings and metadata without some documents and all that belongs to them."""
    gone = documents.select(F.col("id").alias("document_id"))
    chunks = tables["chunks"].join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out = dict(tables)
    out["documents"] = tables["documents"].join(gone, tables["documents"]["id"] == gone["document_id"], "left_anti")
    out["chunks"] = tables["chunks"].join(gone, "document_id", "left_anti")
    out["embeddings"] = tables["embeddings"].join(chunks, "chunk_id", "left_anti")
    if "metadata" in tables:
        out["metadata"] = tables["metadata"].join(chunks, "chunk_id", "left_anti").join(gone, "document_id", "left_anti")
    return out
