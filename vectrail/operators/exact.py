"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import ACTIVE, Metric

#: Decimals to which scores are rounded before ranking, so that ties are ties on every engine.
DIGITS = 6


def active(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows that aren't deleted; any status but active counts as deleted."""
    return rows.where(F.col(status) == ACTIVE) if status in rows.columns else rows


def allowed(rows: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """The rows whose id is in ``ids``: a filter before the search, so a filtered search still fills k."""
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def exact_topk(rows: DataFrame, query: Sequence[float], k: int = 5, metric: str | Metric = Metric.COSINE, key: str = "vec_id", vector: str = "embedding", ids: DataFrame | None = None) -> DataFrame:
    """(key, score) of the k nearest rows, nearest first, ties by key: one scan and a top-k in each task.

    Rows without a usable vector (null, another length, a null or NaN within) are never found.
    """
    m = Metric.of(metric)
    found = allowed(active(rows), ids, key).where(F.size(vector) == len(query)).select(key, F.round(V.measure(m, F.col(vector), V.literal(query)), DIGITS).alias("score"))
    found = found.where(V.known(F.col("score")))
    return found.orderBy(*V.ordering(m, "score", key)).limit(k)


def scores(m: Metric, block: np.ndarray, query: np.ndarray) -> np.ndarray:
    if m is Metric.L2:
        return np.sqrt(((block - query) ** 2).sum(1))
    if m is Metric.MANHATTAN:
        return np.abs(block - query).sum(1)
    products = block @ query
    if m is Metric.DOT:
        return products
    n = np.sqrt((block * block).sum(1)) * np.sqrt(query @ query)
    return np.where(n > 0, products / np.where(n > 0, n, 1.0), 0.0)


def blocked_topk(rows: DataFrame, query: Sequence[float], k: int = 5, metric: str | Metric = Metric.COSINE, key: str = "vec_id", vector: str = "embedding", ids: DataFrame | None = None) -> DataFrame:
    """The same as ``exact_topk`` by one matrix product per Arrow batch: for long vectors and many rows."""
    m, q = Metric.of(metric), np.asarray(query, dtype=np.float64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            s = np.round(scores(m, flat.reshape(b.num_rows, -1), q), DIGITS)
            at = np.lexsort((b.column(0).to_numpy(zero_copy_only=False), -s if m.descending else s))[:k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(s[at])], names=[key, "score"])

    chosen = allowed(active(rows), ids, key).where(V.usable(F.col(vector), len(q))).select(key, vector)
    kind = dict(rows.dtypes)[key]
    return chosen.mapInArrow(run, f"`{key}` {kind}, score double").orderBy(*V.ordering(m, "score", key)).limit(k)


def batch_knn(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str | Metric = Metric.COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows of each query (query_id, query_vector).

    The queries are a stated set: they are sent to the workers in parts of at most ``QUERY_BYTES``, each of which
    goes through the rows once, as matrix products of Arrow batches with blocks of queries. What leaves a batch is
    k rows per query, and the ranking is a window over these. Rows and queries without a usable vector (null,
    another length, a null or NaN within) aren't compared; a query of no usable row has no result.
    """
    m = Metric.of(metric)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {dict(rows.dtypes)[key]}, score double"
    found = None
    for part in query_parts(queries):
        chosen = active(rows).where(V.usable(F.col(vector), part[1].shape[1])).select(key, vector)
        one = chosen.mapInArrow(_nearest(rows, part, k, m, key), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(*V.ordering(m, "score", key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of query vectors that are broadcast together, and queries of one product.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 256


def query_parts(queries: DataFrame):
    """(ids, matrix) parts of the usable queries (query_id, query_vector); vectors of different lengths are in different parts."""
    held: dict[int, tuple[list, list]] = {}
    vector = F.col("query_vector")
    rows = queries.where(vector.isNotNull() & V.usable(vector, F.size(vector))).select("query_id", "query_vector")
    for r in rows.toLocalIterator():
        n = len(r[1])
        ids, vectors = held.setdefault(n, ([], []))
        ids.append(r[0])
        vectors.append(np.asarray(r[1], dtype=np.float64))
        if 8 * n * len(ids) >= QUERY_BYTES:
            yield ids, np.stack(vectors)
            del held[n]
    for n, (ids, vectors) in sorted(held.items()):
        if n:
            yield ids, np.stack(vectors)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def block_scores(m: Metric, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of each row of x (downwards) with each query (across)."""
    if m in (Metric.L2, Metric.MANHATTAN):  # differences keep digits that products lose
        return np.stack([scores(m, x, v) for v in q], axis=1)
    products = x @ q.T
    if m is Metric.DOT:
        return products
    n = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
    return np.where(n > 0, products / np.where(n > 0, n, 1.0), 0.0)


def _nearest(rows: DataFrame, part, k: int, m: Metric, key: str):
    shared = rows.sparkSession.sparkContext.broadcast(part)  # at most QUERY_BYTES

    def run(batches):
        ids, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, keys = matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            n = min(k, len(x))
            for lo in range(0, len(ids), QUERY_BLOCK):
                s = np.round(block_scores(m, x, q[lo : lo + QUERY_BLOCK]), DIGITS)
                s = -s if m.descending else s
                last = np.partition(s, n - 1, axis=0)[n - 1]
                near = [at[np.lexsort((keys[at], s[at, j]))[:n]] for j in range(s.shape[1]) for at in [np.flatnonzero(s[:, j] <= last[j])]]
                flat = np.concatenate(near)
                who = np.repeat(np.arange(s.shape[1]), n)
                got = s[flat, who]
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo + j] for j in who.tolist()]), b.column(0).take(pa.array(flat)), pa.array(-got if m.descending else got)], names=["query_id", key, "score"])

    return run


def recall(found: DataFrame, truth: DataFrame, k: int, by: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(query_id, recall): the share of the true k nearest that were found."""
    a = found.groupBy(by).agg(F.collect_set(key).alias("a"))  # k keys for each query
    b = truth.groupBy(by).agg(F.collect_set(key).alias("b"))
    return b.join(a, by, "left").select(by, (F.size(F.array_intersect(F.coalesce("a", F.array().cast(dict(b.dtypes)["b"])), "b")) / F.lit(float(k))).alias("recall"))
