"""A cache of segments: persisted DataFrames, the least recently used ones let go beyond a size."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

DEFAULT_BYTES = 512 << 20


def memory(rows: DataFrame, vector: str = "embedding", payload: str | None = None) -> DataFrame:
    """(segment_id, records, bytes): four bytes for each dimension, and the payloads' characters."""
    text = F.coalesce(F.sum(F.char_length(payload)), F.lit(0)) if payload else F.lit(0)
    return rows.groupBy("segment_id").agg(F.count("*").alias("records"), (F.coalesce(F.sum(F.size(vector) * 4), F.lit(0)) + text).cast("long").alias("bytes"))


class SegmentCache:
    """Segments by id, loaded when first asked for.

    The rows live in Spark's storage memory, which spills by itself; this class decides what is persisted and
    counts hits and misses. A segment larger than the limit is still admitted, alone.
    """

    def __init__(self, load: Callable[[int], DataFrame], size: Callable[[int], int], max_bytes: int = DEFAULT_BYTES):
        self._load, self._size, self.max_bytes = load, size, max_bytes
        self._kept: OrderedDict[int, tuple[DataFrame, int]] = OrderedDict()
        self.bytes = self.hits = self.misses = 0

    @classmethod
    def of(cls, rows: DataFrame, vector: str = "embedding", max_bytes: int = DEFAULT_BYTES) -> SegmentCache:
        """Over a table with segment_id. The first miss finds the sizes of all segments in one pass: a number for each."""
        sizes: dict[int, int] | None = None

        def size(segment_id: int) -> int:
            nonlocal sizes
            if sizes is None:
                sizes = {r["segment_id"]: r["bytes"] for r in memory(rows, vector).collect()}
            return sizes.get(segment_id, 0)

        return cls(lambda s: rows.where(F.col("segment_id") == s), size, max_bytes)

    @property
    def hit_ratio(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0

    def segment(self, segment_id: int) -> DataFrame:
        if segment_id in self._kept:
            self.hits += 1
            self._kept.move_to_end(segment_id)
            return self._kept[segment_id][0]
        self.misses += 1
        n = self._size(segment_id)
        while self._kept and self.bytes + n > self.max_bytes:
            self.evict(next(iter(self._kept)))
        df = self._load(segment_id).persist()
        self._kept[segment_id] = (df, n)
        self.bytes += n
        return df

    def row(self, segment_id: int, vector_idx: int) -> Row:
        """The row at a place of a segment; IndexError where there is none."""
        found = self.segment(segment_id).where(F.col("vector_idx") == vector_idx).first()
        if found is None:
            raise IndexError(f"segment {segment_id} has no place {vector_idx}")
        return found

    def evict(self, segment_id: int) -> None:
        if segment_id in self._kept:
            df, n = self._kept.pop(segment_id)
            self.bytes -= n
            df.unpersist()

    def clear(self) -> None:
        for s in list(self._kept):
            self.evict(s)
        self.hits = self.misses = 0

    def __contains__(self, segment_id: int) -> bool:
        return segment_id in self._kept
