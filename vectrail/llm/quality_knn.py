"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document is a TF-IDF vector of hashed terms: character n-grams with case and marks kept, word shapes, and
coarse statistics of the text as terms. Document frequencies are counted over all documents. A truncated
singular value decomposition of a bounded sample of labelled rows (``max_rows``) gives the latent space;
the sample's unit vectors and labels are broadcast. For every document the cosines with all of them are one
blocked matrix product, and the ``neighbours`` nearest vote with their similarities as weights.

Cases: a null or empty text has only its statistics terms and is scored like any other; without labelled rows the score is
0.5; ties among neighbours go to the earlier row of the sample, which is ordered by a hash of the id; equal rows
get equal scores; null labels aren't learned; a document with several labels is learned with each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import _IS_WORD, byte_ranges, mix
from .common import append_arrow, unit_hash

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 12  # hashed terms
    latent: int = 48  # dimensions
    max_rows: int = 3000  # labelled rows that are fitted on, at the most
    neighbours: int = 25
    power: float = 4.0  # of a similarity, as a voting weight
    block: int = 512  # documents of one matrix product


# Classes of bytes for word shapes: lower, upper, digit, other letter (beyond ASCII), and each mark for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")
_SHAPE[~_IS_WORD] = 32


def term_counts(data: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of the hashed terms of one text's bytes."""
    shift = _U(64 - buckets.bit_length() + 1)
    out = np.zeros(buckets, dtype=np.int64)

    def add(h: np.ndarray, kind: int) -> None:
        nonlocal out
        out = out + np.bincount((mix(h + _U(kind << 58)) >> shift).astype(np.int64), minlength=buckets)

    shape = _SHAPE[data]
    # Shapes and raw bytes, n-grams of each: the shapes say how a text is written, whatever its language.
    for kind, x, orders in ((1, shape, (1, 2, 3)), (2, data, (1, 2))):
        h = np.zeros(len(x), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] * _U(257)) + x[n - 1 :].astype(np.uint64)
            if n in orders:
                add(h, kind * 8 + n)
    # Runs of equal shape as one: Aa, A, aa! and so on, by the word.
    if len(shape):
        first = np.append(True, shape[1:] != shape[:-1])
        r = shape[first].astype(np.uint64)
        if len(r) >= 3:
            add((r[:-2] * _U(257) + r[1:-1]) * _U(257) + r[2:], 30)
    inside = shape != 32
    words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])
    lines = int(np.count_nonzero(data == 10)) + 1
    stats = (words.bit_length(), len(data).bit_length(), int(2 * np.log2(max(1.0, len(data) / max(1, words)))), int(2 * np.log2(max(1.0, words / lines))))
    for i, v in enumerate(stats):
        add(np.full(1, v, np.uint64), 40 + i)
    return out


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    settings: Settings
    idf: np.ndarray
    axes: np.ndarray  # buckets x latent
    vectors: np.ndarray  # latent x rows, unit columns
    labels: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, off = byte_ranges(texts)
        s = self.settings
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        for lo in range(0, len(texts), s.block):
            hi = min(lo + s.block, len(texts))
            x = np.stack([_weights(term_counts(data[off[i] : off[i + 1]], s.buckets), self.idf) for i in range(lo, hi)])
            out[lo:hi] = self.vote(_unit(x @ self.axes))
        return out

    def vote(self, z: np.ndarray) -> np.ndarray:
        cosine = z @ self.vectors
        k = min(self.settings.neighbours, len(self.labels))
        near = nearest(cosine, k)
        w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** self.settings.power
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0.0, 1.0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest cosines of each row, equal ones (to 9 decimals) in order of place: no two keys are equal."""
    m = cosine.shape[1]
    key = np.rint(cosine * 1e9).astype(np.int64) * m - np.arange(m)
    some = np.argpartition(-key, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(key, some, 1), axis=1)
    return np.take_along_axis(some, order, 1)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)


def _document_frequencies(docs: DataFrame, text: str, s: Settings) -> np.ndarray:
    """Inverse document frequencies over all rows; each task sends one count per bucket."""

    def count(batches):
        total, n = np.zeros(s.buckets, np.int64), 0
        for b in batches:
            data, off = byte_ranges(b.column(0))
            n += b.num_rows
            for i in range(b.num_rows):
                total += term_counts(data[off[i] : off[i + 1]], s.buckets) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most buckets + 1 rows
    found = {r["bucket"]: r["n"] for r in rows}
    n, df = found.pop(-1, 0), np.zeros(s.buckets)
    df[list(found)] = list(found.values())
    return np.log((1 + n) / (1 + df)) + 1


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", settings: Settings | None = None) -> Model:
    """``docs`` gives the document frequencies; ``labels`` has the key and label of the rows that may be learned from.

    The labels are sampled before their texts are looked up, so at most ``max_rows`` of them are broadcast.
    """
    s = settings or Settings()
    idf = _document_frequencies(docs, text, s)
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("y"), unit_hash(F.col(key).cast("string"), F.lit("knn")).alias("u"))
    n = known.count()
    known = known.where(F.col("u") < min(1.0, 1.05 * s.max_rows / max(1, n))).orderBy("u", "__key", "y").limit(s.max_rows)
    rows = docs.join(F.broadcast(known), F.col(key) == F.col("__key")).select("y", F.col(text).alias("t"), "u")

    def make(batches):
        for b in batches:
            data, off = byte_ranges(b.column(1))
            x = [term_counts(data[off[i] : off[i + 1]], s.buckets).astype(np.float32) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in x], pa.binary())], names=["y", "u", "x"])

    sample = rows.mapInArrow(make, "y double, u double, x binary").orderBy("u", "y", "x").limit(s.max_rows).collect()
    if not sample:
        return Model(s, idf, np.zeros((s.buckets, 1)), np.zeros((1, 0)), np.zeros(0))
    x = np.stack([_weights(np.frombuffer(pa.decompress(r["x"], decompressed_size=4 * s.buckets, codec="zstd", asbytes=True), np.float32).astype(np.float64), idf) for r in sample])
    # Right singular vectors from the smaller Gram matrix.
    d = min(s.latent, *x.shape)
    value, left = np.linalg.eigh(x @ x.T)
    value, left = value[::-1][:d], left[:, ::-1][:, :d]
    keep = value > 1e-10 * max(value[0], 1e-300)
    axes = x.T @ left[:, keep] / np.sqrt(value[keep])
    return Model(s, idf, axes, np.ascontiguousarray(_unit(x @ axes).T), np.array([r["y"] for r in sample]))


def score(docs: DataFrame, model: Model, text: str = "text", cutoff: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_rows x latent and buckets x latent numbers

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            p = np.round(shared.value.scores(texts), 9)
            return [pa.array(p), pa.array((p >= cutoff).astype(np.int32))]

        return fn

    return append_arrow(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


