"""Schemas of the engine's tables, metrics and collection parameters."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, k != "id") for k, v in columns.items()])


VECTOR = T.ArrayType(T.FloatType())
USERS = _table(id=_S, username=_S, hashed_password=_S, role=_S, is_active=_B, created_at=_TS)
COLLECTIONS = _table(id=_S, name=_S, namespace=_S, dimension=_I, metric=_S, created_by=_S, created_at=_TS)
DOCUMENTS = _table(id=_S, collection_id=_S, title=_S, content_hash=_S, status=_S, created_at=_TS, updated_at=_TS)
CHUNKS = _table(id=_S, document_id=_S, text_content=_S, chunk_index=_I, token_count=_I, created_at=_TS)
EMBEDDINGS = _table(id=_S, chunk_id=_S, segment_id=_L, vector_idx=_L, vector_data=VECTOR, status=_I, created_at=_TS)
METADATA = _table(id=_S, document_id=_S, chunk_id=_S, key=_S, value=_S, created_at=_TS)
AUDIT_LOGS = _table(id=_S, user_id=_S, action=_S, target_id=_S, details=_S, ip_address=_S, created_at=_TS)
TASKS = _table(id=_S, task_type=_S, status=_S, payload=_S, error_message=_S, created_at=_TS, updated_at=_TS)
GRAPHS = _table(segment_id=_L, vec_id=_L, vector_idx=_L, level=_I, is_entry=_B, neighbors=T.ArrayType(T.ArrayType(_L)))
REDIRECTS = _table(vec_id=_L, old_segment_id=_L, old_vector_idx=_L, segment_id=_L, vector_idx=_L)
VECTORS = _table(vec_id=_L, embedding=VECTOR, status=_I, segment_id=_L, vector_idx=_L)
STATES = _table(document_id=_S, content_hash=_S, status=_S, attempt=_I, message=_S, batch=_S)
TABLES = {
    "users": USERS, "collections": COLLECTIONS, "documents": DOCUMENTS, "chunks": CHUNKS,
    "embeddings": EMBEDDINGS, "metadata": METADATA, "audit_logs": AUDIT_LOGS, "tasks": TASKS,
    "graphs": GRAPHS, "redirects": REDIRECTS, "vectors": VECTORS, "document_states": STATES,
}

ACTIVE, TOMBSTONE = 1, 2


class Metric(Enum):
    """Similarity measures; the value says whether a larger score is nearer."""

    COSINE = ("cosine", True)
    L2 = ("l2", False)
    DOT = ("dotproduct", True)
    MANHATTAN = ("manhattan", False)

    @property
    def descending(self) -> bool:
        return self.value[1]

    @classmethod
    def of(cls, name: str | Metric) -> Metric:
        """By name in any case; EUCLIDEAN is L2. Unknown names are refused."""
        if isinstance(name, Metric):
            return name
        low = name.lower().replace("_", "")
        for m in cls:
            if low == m.value[0] or low == m.name.lower() or low == "euclidean" and m is cls.L2:
                return m
        raise ValueError(f"unknown metric {name!r}")


@dataclass(frozen=True)
class Collection:
    name: str
    dimension: int
    metric: Metric = Metric.COSINE
    namespace: str = "default"
    segment_capacity: int = 50_000

    def __post_init__(self):
        if self.dimension <= 0 or self.segment_capacity <= 0:
            raise ValueError("dimension and segment capacity must be positive")

    def check(self, vector) -> None:
        """Refuse a query vector of another length."""
        if len(vector) != self.dimension:
            raise ValueError(f"the collection {self.name!r} has {self.dimension} dimensions, not {len(vector)}")


def ddl(table: str) -> str:
    """CREATE TABLE for one of the engine's tables; DROP TABLE undoes it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in TABLES[table].fields)
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet"
