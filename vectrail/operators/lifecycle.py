"""The life of a collection in a store: documents' states, sealing and indexing, compaction, and the search strategies.

Vectors are rows (vec_id, embedding, status, segment_id, vector_idx) of the table ``vectors``; graphs of sealed
segments are the table ``graphs``, built once and read by every search. Each step is one commit of the store:
what fails leaves the last commit as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, derived_id
from ..plans.cost import EXACT, HNSW
from ..plans.planner import StrategyRegistry
from ..schemas import ACTIVE, TABLES, Collection
from ..sources.store import Store
from . import exact, hnsw, segments
from .ingest import ingest, new_documents

PENDING, COMPLETED, FAILED = "pending", "completed", "failed"


def as_table(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, absent ones as null."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))


# --- documents ----------------------------------------------------------------------------------------------


def states(store: Store) -> DataFrame:
    """(document_id, content_hash, status, attempt, message): the last state of each document; an attempt ends after it began."""
    order = F.struct("attempt", (F.col("status") != PENDING).cast("int").alias("ended"), "status", "message")
    last = store.read("document_states").groupBy("document_id", "content_hash").agg(F.max(order).alias("s"))
    return last.select("document_id", "content_hash", "s.status", "s.attempt", "s.message")


def ingest_documents(store: Store, docs: DataFrame, collection: Collection, key: str = "doc_id", text: str = "text", **options) -> str:
    """Ingest a batch and give its name. Its new documents are noted as pending first; they end as completed together
    with their rows, in one commit, or as failed with the error, which is raised. A failed or interrupted document is
    taken again, as its next attempt, when a batch has it again; completed ones are skipped."""
    batch = uuid.uuid4().hex
    # The batch is read for its new contents here and for their texts below; the second must find what the first found.
    new = store.staged(new_documents(docs, collection, store.read("documents"), options.get("chunker"), key, text), "new")
    found = new.select(derived_id(F.lit(collection.name), F.col("content_hash")).alias("document_id"), "content_hash")
    tried = states(store).select("document_id", F.col("attempt").alias("n"))
    todo = found.join(tried, "document_id", "left").select("document_id", "content_hash", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt"))
    noted = lambda status, message=None: as_table(todo.withColumns({"status": F.lit(status), "message": F.lit(message).cast("string"), "batch": F.lit(batch)}), "document_states")
    todo = store.staged(todo, "todo")
    store.append({"document_states": noted(PENDING)})
    try:
        made = ingest(docs, collection, key=key, text=text, start=store.rows("embeddings"), keep=store.staged, new=new, **options)
        # Embeddings first: what fails is most often a model.
        frames = {"embeddings": made.embeddings, "chunks": made.chunks, "documents": made.documents, "audit_logs": made.audit}
        store.append({t: as_table(df, t) for t, df in frames.items()} | {"document_states": noted(COMPLETED)})
    except Exception as e:
        store.append({"document_states": noted(FAILED, f"{type(e).__name__}: {str(e)[:500]}")})
        raise
    return batch


# --- vectors ------------------------------------------------------------------------------------------------


def add_vectors(store: Store, rows: DataFrame, capacity: int, key: str = "vec_id", vector: str = "embedding", index: bool = True, **build) -> None:
    """Append vectors to the growing segment and new ones; segments that are full by then get their graphs."""
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit(ACTIVE))
    new = segments.assign(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), "status"), "vec_id", capacity, start=store.rows("vectors"))
    store.append({"vectors": as_table(new, "vectors")}, {"vectors": []})
    if index:
        seal(store, capacity, **build)


def unindexed(store: Store, capacity: int) -> DataFrame:
    """(segment_id): full segments without a graph."""
    full = segments.stats(store.read("vectors"), capacity).where(F.col("state") == "sealed").select("segment_id")
    return full.join(store.read("graphs").select("segment_id").distinct(), "segment_id", "left_anti")


def seal(store: Store, capacity: int, metric="cosine", p: hnsw.Parameters | None = None) -> None:
    """Build and store the graphs of full segments that have none. Growing segments stay without: they are scanned."""
    rows = store.read("vectors").join(unindexed(store, capacity), "segment_id", "left_semi")
    store.append({"graphs": as_table(hnsw.build_index(rows, metric, p), "graphs")})


def delete_vectors(store: Store, gone: DataFrame) -> None:
    """Soft delete: the rows become tombstones, which lead a graph search on but aren't found."""
    read = store.manifest()
    store.replace({"vectors": as_table(segments.mark_deleted(store.read("vectors"), gone, "vec_id"), "vectors")}, read=read)


def compact(store: Store, capacity: int, tombstone_share: float = 0.2, metric="cosine", p: hnsw.Parameters | None = None) -> bool:
    """Rewrite eligible segments without tombstones: new segments behind the last one, their graphs, and a redirect for
    each moved row replace the old segments and graphs in one commit. Whether there was anything to do.

    Live rows are written and indexed before the commit. If anything fails, or another writer changes the vectors
    meanwhile, the old segments stay; the unnamed files go with the next ``vacuum``. New segments are numbered on
    from the highest number ever used, so an old place is never taken again.
    """
    read = store.manifest()
    rows = store.read("vectors")
    per = segments.stats(rows, capacity)
    chosen = store.staged(segments.eligible(per, capacity, tombstone_share).select("segment_id"), "eligible")
    if chosen.isEmpty():
        return False
    used = rows.select("segment_id").unionByName(store.read("redirects").select("segment_id"))
    first = used.agg(F.coalesce(F.max("segment_id"), F.lit(-1)) + 1).first()[0]  # one number
    moved = segments.compact(rows, capacity, chosen).withColumn("segment_id", F.col("segment_id") + first)
    moved = store.staged(moved, "compacted")
    kept = rows.join(chosen, "segment_id", "left_anti")
    full = moved.groupBy("segment_id").count().where(F.col("count") >= capacity).select("segment_id")
    graphs = store.read("graphs").join(chosen, "segment_id", "left_anti").unionByName(as_table(hnsw.build_index(moved.join(full, "segment_id", "left_semi"), metric, p), "graphs"))
    # A row that moved before is redirected from its first place too.
    old = store.read("redirects").alias("r").join(moved.select("vec_id", F.col("segment_id").alias("s"), F.col("vector_idx").alias("i")).alias("m"), "vec_id", "left")
    old = old.select("vec_id", "old_segment_id", "old_vector_idx", F.coalesce("s", "r.segment_id").alias("segment_id"), F.coalesce("i", "r.vector_idx").alias("vector_idx"))
    redirects = old.unionByName(as_table(moved, "redirects"))
    store.replace({"vectors": as_table(kept, "vectors").unionByName(as_table(moved, "vectors")), "graphs": graphs, "redirects": as_table(redirects, "redirects")}, read=read)
    return True


def redirected(store: Store, places: DataFrame) -> DataFrame:
    """(segment_id, vector_idx) places as they are now: moved rows by their redirect, others as they were."""
    r = store.read("redirects").select(F.col("old_segment_id").alias("__s"), F.col("old_vector_idx").alias("__i"), F.col("segment_id").alias("__ns"), F.col("vector_idx").alias("__ni"))
    both = places.join(r, (F.col("segment_id") == F.col("__s")) & (F.col("vector_idx") == F.col("__i")), "left")
    return both.withColumns({"segment_id": F.coalesce("__ns", "segment_id"), "vector_idx": F.coalesce("__ni", "vector_idx")}).drop("__s", "__i", "__ns", "__ni")


# --- search -------------------------------------------------------------------------------------------------


def strategies(rows: Callable[[], DataFrame], index: Callable[[], DataFrame], metric="cosine", ef: int | None = None, key: str = "vec_id", vector: str = "embedding") -> StrategyRegistry:
    """EXACT, a scan of all vectors, and HNSW, the graphs of sealed segments with a scan of the others, for the planner."""
    r = StrategyRegistry()
    r.register(EXACT, lambda q, k, ids: exact.exact_topk(rows(), q, k, metric, key, vector, ids))
    r.register(HNSW, lambda q, k, ids: hnsw.ann_topk(rows(), index(), q, k, metric, key, vector, ids, ef))
    return r


def of_store(store: Store, metric="cosine", ef: int | None = None) -> StrategyRegistry:
    return strategies(lambda: store.read("vectors"), lambda: store.read("graphs"), metric, ef)
