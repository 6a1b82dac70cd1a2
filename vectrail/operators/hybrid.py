"""Hybrid search: vector similarity and keyword overlap in one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import keyword_score, query_words
from ..schemas import Metric
from .exact import DIGITS, active, allowed


def semantic_scores(rows: DataFrame, query: Sequence[float], metric: str | Metric, key: str, vector: str, ids: DataFrame | None = None) -> DataFrame:
    """(key, semantic): a similarity, larger is nearer, whatever the metric; rows without a usable vector have none."""
    m = Metric.of(metric)
    s = V.similarity(m, V.measure(m, F.col(vector), V.literal(query)))
    return allowed(active(rows), ids, key).where(F.size(vector) == len(query)).select(key, s.alias("semantic")).where(V.known(F.col("semantic")))


def keyword_scores(texts: DataFrame, query_text: str, key: str, text: str) -> DataFrame:
    return texts.select(key, keyword_score(F.col(text), query_words(query_text)).alias("keyword"))


def fuse(semantic: DataFrame, keyword: DataFrame, alpha: float, key: str, candidates: str = "semantic") -> DataFrame:
    """(key, semantic, keyword, score) with score = alpha * semantic + (1 - alpha) * keyword.

    With ``candidates="semantic"`` keywords only re-rank; with ``"union"`` keyword hits are candidates too.
    """
    how = {"semantic": "left", "union": "full"}[candidates]
    both = semantic.join(keyword if how == "left" else keyword.where(F.col("keyword") > 0), key, how)
    both = both.select(key, F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    return both.withColumn("score", F.round(alpha * F.col("semantic") + (1 - alpha) * F.col("keyword"), DIGITS))


def hybrid_topk(
    rows: DataFrame, texts: DataFrame, query: Sequence[float], query_text: str, k: int = 5, alpha: float = 0.5, metric: str | Metric = Metric.COSINE,
    key: str = "vec_id", vector: str = "embedding", text: str = "text", ids: DataFrame | None = None, candidates: str = "semantic",
) -> DataFrame:
    """The k best by the fused score, ties by key. Texts are reduced to a number before the join."""
    semantic = semantic_scores(rows, query, metric, key, vector, ids)
    keyword = keyword_scores(allowed(texts, ids, key), query_text, key, text)
    return fuse(semantic, keyword, alpha, key, candidates).orderBy(F.col("score").desc(), F.col(key).asc()).limit(k)


def hybrid_ann_topk(
    rows: DataFrame, index: DataFrame, texts: DataFrame, query: Sequence[float], query_text: str, k: int = 5, alpha: float = 0.5, metric: str | Metric = Metric.COSINE,
    key: str = "vec_id", vector: str = "embedding", text: str = "text", ids: DataFrame | None = None, ef: int | None = None, overfetch: int = 2,
) -> DataFrame:
    """Hybrid search over graph segments and a scan of growing ones: the ``overfetch`` * k nearest are re-ranked by the fused score."""
    from .hnsw import ann_topk

    m = Metric.of(metric)
    near = ann_topk(rows, index, query, overfetch * k, m, key, vector, ids, ef)
    semantic = near.select(key, V.similarity(m, F.col("score")).alias("semantic"))
    keyword = keyword_scores(texts.join(F.broadcast(semantic.select(key)), key, "left_semi"), query_text, key, text)  # overfetch * k ids
    return fuse(semantic, keyword, alpha, key).orderBy(F.col("score").desc(), F.col(key).asc()).limit(k)


def hydrate(hits: DataFrame, texts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Hits with a ``payload`` of further columns: joined after the top-k, so only k rows are looked up."""
    payload = texts.select(F.col(key).alias("__key"), F.struct(*columns).alias("payload"))
    return payload.join(F.broadcast(hits), F.col("__key") == F.col(key)).drop("__key")  # hits are k rows


def reciprocal_rank(lists: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """(key, score): reciprocal-rank fusion of lists that have (key, rank)."""
    out = lists[0].select(key, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(key, "rank"))
    return out.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), DIGITS).alias("score"))
