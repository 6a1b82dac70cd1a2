"""Ingestion: documents to chunks, vectors and segment places, idempotent on the content."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.embedders import FeatureHash
from ..functions.text import content_hash, derived_id, token_count
from ..schemas import ACTIVE, Collection
from ..session import shared_dir
from ..sources.store import Store
from .segments import ordinals

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass
class Ingested:
    """The new rows of each table. Chunks and embeddings are made from one written copy of the new texts, which is
    written when either is first asked for."""

    documents: DataFrame
    audit: DataFrame
    _parts: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame]:
        return self._parts()

    @property
    def chunks(self) -> DataFrame:
        return self._made[0]

    @property
    def embeddings(self) -> DataFrame:
        """With the document's key and the chunk's number, besides the table's columns."""
        return self._made[1]


def keeper(spark) -> Keep:
    """Writes intermediate rows to a new folder among those that driver and executors share."""
    return Store(spark, f"{shared_dir(spark)}/vectrail-{spark.sparkContext.applicationId}/ingest-{uuid.uuid4().hex}").staged


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """Texts that aren't blank, with their hash."""
    return docs.where(F.col(text).rlike(r"\S")).withColumn("content_hash", content_hash(F.col(text)))


def new_documents(docs: DataFrame, collection: Collection, existing: DataFrame | None = None, chunker=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, key, chunks): one document for each new content of the collection, that of the smallest key.

    Empty texts are refused. Only hashes and keys are shuffled, not the texts.
    """
    rows = chunking.counts(chunker or chunking.Fixed(), _hashed(docs, text).select("content_hash", F.col(key).alias("key"), text), text, "chunks")
    first = rows.where(F.col("key").isNotNull()).groupBy("content_hash").agg(F.min(F.struct("key", "chunks")).alias("f")).select("content_hash", "f.key", "f.chunks")
    if existing is None:
        return first
    done = existing.where((F.col("collection_id") == collection.name) & (F.col("status") == "completed"))
    return first.join(done.select("content_hash"), "content_hash", "left_anti")


def ingest(
    docs: DataFrame, collection: Collection, existing: DataFrame | None = None, chunker=None, embedder=None, key: str = "doc_id", text: str = "text", start: int = 0,
    keep: Keep | None = None, new: DataFrame | None = None,
) -> Ingested:
    """The new rows of each table. ``start`` is the number of vectors that the collection already has.

    ``new`` are the ``new_documents`` where the caller has written them already. ``keep`` writes intermediate rows. The
    documents are read twice, for their hashes and for their texts; texts are shuffled once and then written with the
    place of their first chunk, so that chunks, vectors and places need no further shuffle.
    """
    chunker = chunker or chunking.Fixed()
    embedder = embedder or FeatureHash(collection.dimension)
    if embedder.dimension != collection.dimension:
        raise ValueError(f"the embedder gives {embedder.dimension} dimensions, the collection has {collection.dimension}")
    keep = keep or keeper(docs.sparkSession)
    if new is None:
        new = keep(new_documents(docs, collection, existing, chunker, key, text), "new")
    name = F.lit(collection.name)
    ident = derived_id(name, F.col("content_hash"))
    documents = new.select(ident.alias("id"), name.alias("collection_id"), F.col("key").cast("string").alias("title"), "content_hash", F.lit("completed").alias("status"), F.col("key").alias("source_key"))
    audit = documents.select(derived_id(F.col("id"), F.lit("ingest")).alias("id"), F.lit("INGEST_DOCUMENT").alias("action"), F.col("id").alias("target_id"), F.to_json(F.struct("content_hash")).alias("details"))

    def parts() -> tuple[DataFrame, DataFrame]:
        both = ["content_hash", "key"]
        found = _hashed(docs, text).select("content_hash", F.col(key).alias("key"), F.col(text).alias("text"))
        texts = keep(found.join(_offsets(new, start), both).dropDuplicates(both), "texts")
        if texts.count() != new.count():  # from the files' footers
            raise RuntimeError("the documents changed while they were read")
        pieces = chunker.chunk(texts.select(ident.alias("document_id"), F.col("key").alias("source_key"), "offset", "text"), "text")
        chunks = pieces.select(derived_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", F.col("chunk").alias("text_content"), "chunk_index", token_count(F.col("chunk")).alias("token_count"), "source_key", "offset")
        vectors = embedder.embed(chunks.withColumnRenamed("id", "chunk_id"), "text_content", ["chunk_id", "source_key", "chunk_index", "offset"], "vector_data").drop("text_content")
        # The order of ingestion: by document, then by chunk.
        ordinal = F.col("offset") + F.col("chunk_index")
        places = F.floor(ordinal / collection.segment_capacity).cast("long").alias("segment_id"), (ordinal % collection.segment_capacity).cast("long").alias("vector_idx")
        return chunks.drop("offset"), vectors.select(derived_id(F.col("chunk_id"), F.lit("v")).alias("id"), "chunk_id", *places, "vector_data", F.lit(ACTIVE).alias("status"), "source_key", "chunk_index")

    return Ingested(documents, audit, parts)


def _offsets(new: DataFrame, start: int) -> DataFrame:
    """(content_hash, key, offset): the place of each document's first chunk: documents' chunk counts are added up in the order of keys."""
    numbered = ordinals(new, "key", "__doc")
    # Prefix sums by blocks of documents: the sums of whole blocks are few rows.
    block = F.floor(F.col("__doc") / 100_000)
    numbered = numbered.withColumn("__block", block)
    sums = numbered.groupBy("__block").agg(F.sum("chunks").alias("__s"))
    before_block = F.coalesce(F.sum("__s").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("chunks").over(Window.partitionBy("__block").orderBy("__doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = numbered.withColumn("__w", within).join(F.broadcast(sums.select("__block", before_block.alias("__b"))), "__block")
    return offsets.select("content_hash", "key", (F.col("__w") + F.col("__b") + start).cast("long").alias("offset"))
