"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training (follow-the-regularised-leader with elastic-net penalties, then a temperature fitted on a
calibration fold) uses a bounded sample of labelled rows, ``max_rows``; document frequencies are counted over
all rows that may be learned from. Prediction reads whole texts, with a weight matrix of bounded size.

Cases: a null text, or one without a letter, gives ``und`` and score 0; so does every text when nothing
could be learned (empty table, no labels). Rows are predicted one by one: order, equal rows and null ids
don't matter. A long text is handled in blocks of characters, which changes no count. More labels than
``max_labels`` are an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, unit_hash

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)  # lengths of the n-grams, in code points
    buckets: int = 1 << 14  # hashed n-grams
    max_rows: int = 4000  # labelled rows that are fitted on, at the most
    max_labels: int = 256  # more labels than this are an error: the model has a row of weights for each
    epochs: int = 4
    alpha: float = 0.5  # FTRL learning rate
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    calibration: float = 0.2  # share of the sample kept for the temperature


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


_BLOCK = 1 << 18


def ngram_counts(text: str, orders: tuple[int, ...], buckets: int) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased text, runs of other characters as one space; None without a letter.

    Blocks of the text are read with the last characters before them, so that where a block ends changes nothing.
    """
    out, found = np.zeros(buckets, dtype=np.int64), False
    shift = np.uint64(64 - buckets.bit_length() + 1)
    longest = max(orders)
    low = text.lower()
    tail, after_letter = np.empty(0, np.uint64), True
    for begin in range(0, len(low), _BLOCK):
        codes = np.frombuffer(low[begin : begin + _BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        found = found or bool(letter.any())
        keep = letter | np.append(after_letter, letter[:-1])
        after_letter = letter[-1]
        c = np.concatenate([tail, np.where(letter, codes, 32)[keep].astype(np.uint64)])
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, longest + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            if n in orders:
                own = h[max(0, len(tail) - n + 1) :]  # those that end in this block
                if n == 1:
                    own = own[c[len(tail) :] != 32]
                salt = np.uint64(n * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
                np.add.at(out, ((own + salt) * np.uint64(0xA0761D6478BD642F) >> shift).astype(np.int64), 1)
        tail = c[max(0, len(c) - longest + 1) :]
    return out if found else None


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    settings: Settings
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # labels x buckets, mostly zero
    bias: np.ndarray
    temperature: float

    def scores(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text, self.settings.orders, self.settings.buckets) if text and self.labels else None
        if counts is None:
            return UNKNOWN, 0.0
        at, x = _tfidf(counts, self.idf)
        z = (self.weights[:, at] @ x + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def _document_frequencies(docs: DataFrame, text: str, s: Settings) -> tuple[np.ndarray, int]:
    """Over all rows: each task sends one count per bucket, and these are added."""

    def count(batches):
        total, n = np.zeros(s.buckets, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                c = ngram_counts(t, s.orders, s.buckets) if t else None
                if c is not None:
                    total += c > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most buckets + 1 rows
    df = np.zeros(s.buckets, dtype=np.int64)
    found = {r["bucket"]: r["n"] for r in rows}
    n = found.pop(-1, 0)
    df[list(found.keys())] = list(found.values())
    return df, n


def _sample(docs: DataFrame, text: str, label: str, key: str, s: Settings) -> tuple[list[str], list[tuple[int, np.ndarray]]]:
    """At most ``max_rows`` labelled rows as n-gram counts, about as many of each label, chosen by a hash of the id."""
    sizes = docs.groupBy(F.col(label).alias("label")).count().limit(s.max_labels + 1).collect()
    if not sizes:
        return [], []
    if len(sizes) > s.max_labels:
        raise ValueError(f"more than {s.max_labels} labels to learn; give Settings a larger max_labels")
    labels = sorted(r["label"] for r in sizes)
    each = s.max_rows / len(sizes)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["label"], min(1.0, each / r["count"]))))
    u = unit_hash(F.col(key).cast("string"), F.lit("sample"))
    chosen = docs.select(F.col(label).alias("label"), F.col(text).alias("text"), u.alias("u")).where(F.col("u") < F.try_element_at(share, F.col("label")))

    def make(batches):
        for b in batches:
            names, texts, us = (b.column(i).to_pylist() for i in range(3))
            keep = [(n, u, c) for n, t, u in zip(names, texts, us, strict=True) if t and (c := ngram_counts(t, s.orders, s.buckets)) is not None]
            if keep:
                at = [np.flatnonzero(c) for _, _, c in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _, _ in keep]), pa.array([u for _, u, _ in keep]), pa.array([a.astype("<i4").tobytes() for a in at]), pa.array([c[a].astype("<i4").tobytes() for a, (_, _, c) in zip(at, keep, strict=True)])],
                    names=["label", "u", "at", "n"],
                )

    rows = chosen.mapInArrow(make, "label string, u double, at binary, n binary").orderBy("u", "label", "at", "n").limit(s.max_rows).collect()
    place = {x: i for i, x in enumerate(labels)}
    return labels, [(place[r["label"]], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden sections over its logarithm."""
    if not len(y):
        return 1.0
    # A pseudo-document of even odds keeps a separable fold from a temperature of zero.
    loss = lambda t: -np.mean(np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-300))) + 0.01 * np.log(t) ** 2
    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", settings: Settings | None = None) -> Model:
    """Learn from the rows of ``docs`` whose label isn't null. The caller leaves out held-out rows."""
    s = settings or Settings()
    docs = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    df, n = _document_frequencies(docs, text, s)
    idf = np.log((1 + n) / (1 + df)) + 1
    labels, rows = _sample(docs, text, label, key, s)
    if not rows:
        return Model(s, [], idf, np.zeros((0, s.buckets)), np.zeros(0), 1.0)
    examples = []
    for y, at, c in rows:
        x = np.log1p(c) * idf[at]
        examples.append((y, at, x / max(np.sqrt(x @ x), 1e-12)))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(examples))
    n_cal = int(len(examples) * s.calibration)
    cal, train = order[:n_cal], order[n_cal:]
    k = len(labels)
    z = np.zeros((k, s.buckets + 1))
    sq = np.zeros((k, s.buckets + 1))  # the last column is the bias

    def weights(z, sq):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(sq)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in rng.permutation(train):
            y, at, x = examples[i]
            at, x = np.append(at, s.buckets), np.append(x, 1.0)
            zi, ni = z[:, at], sq[:, at]
            w = weights(zi, ni)
            g = _softmax(w @ x)
            g[y] -= 1
            g = np.outer(g, x)
            new = ni + g * g
            z[:, at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / s.alpha * w
            sq[:, at] = new
    w = weights(z, sq)
    logits = np.array([w[:, examples[i][1]] @ examples[i][2] + w[:, -1] for i in cal]).reshape(-1, k)
    t = _temperature(logits, np.array([examples[i][0] for i in cal], dtype=int))
    return Model(s, labels, idf, np.ascontiguousarray(w[:, :-1]), w[:, -1].copy(), t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # labels x buckets numbers

    def make():
        m = shared.value

        def fn(texts: pa.Array) -> list[pa.Array]:
            found = [m.scores(t) for t in texts.to_pylist()]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]

        return fn

    return append_arrow(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


_KNOWN = "__known_language"


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``; the columns of ``docs``.

    A score is at least one in the number of labels, so with three labels or fewer the default rejects only
    texts without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(texts: pa.Array) -> list[pa.Array]:
            found = (m.scores(t) for t in texts.to_pylist())
            return [pa.array([lang != UNKNOWN and p >= least for lang, p in found], pa.bool_())]

        return fn

    return append_arrow(docs, text, [T.StructField(_KNOWN, T.BooleanType())], make).where(_KNOWN).drop(_KNOWN)
