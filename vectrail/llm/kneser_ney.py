"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: each task counts its own bigrams first and sends them, dictionary-coded, to shards by the hash of
the whole bigram, so that a frequent word's bigrams spread over all shards; with many shards by way of wide ones,
so that the blobs sent stay few. A shard adds its counts and writes them as a sorted array of 64-bit hashes with an
array of counts beside it, in one file. From the shards, per-word statistics (tokens, distinct predecessors,
followers seen once, twice, three times or more) go to shards by the word's hash and are written in the same
way. Only totals reach the driver.

Scoring: workers map the files of the shared folder, a bounded number at a time, and look a batch's distinct words
and sorted bigrams up by binary search, shard after shard. Memory is bounded by a batch; the mapped pages belong to
the page cache.

A word is known by 64 bits of hash. The model is a distribution over the training words, the end and one
unknown word, to which all words outside the training texts belong.

Cases: a null text is empty and has the end as its only token; without training texts each token has
probability 1; equal rows and rows of one id are scored, and counted, one by one; a null id isn't held out.
"""

from __future__ import annotations

import io
import json
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import pair_hash, words
from .common import append_arrow, mapped_file, new_path, store_bytes

_U = np.uint64
BEGIN, END = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179)
#: Tokens that a task counts before it sends them on.
FLUSH = 3_000_000
#: Columns of a word's statistics: tokens, distinct predecessors, followers seen 1, 2, 3, 4 and 3 or more times.
COLUMNS = ("tokens", "before", "f1", "f2", "f3", "f4", "f3up")


def _bigrams(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, document) of every token of a batch of words, ends included."""
    n = np.diff(w.bounds)
    at = w.bounds[1:] + np.arange(w.n_docs)  # of the ends
    total = len(w.hash) + w.n_docs
    token = np.empty(total, np.uint64)
    inner = np.ones(total, dtype=bool)
    inner[at] = False
    token[inner], token[at] = w.hash, END
    context = np.empty(total, np.uint64)
    context[1:] = token[:-1]
    context[at - n] = BEGIN
    return context, token, np.repeat(np.arange(w.n_docs), n + 1)


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: high bytes are mostly zero."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unplanes(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.empty(0, dtype)
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _sum_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))) if len(v) else np.empty(0, np.int64)
    if c is None:
        n = np.diff(np.append(new, len(v)))
    else:
        n = np.add.reduceat(c[order], new) if len(new) else np.empty(0, np.int64)
    return v[new], w[new], n.astype(np.int64)


def _top(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> _U(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def _blobs(v: np.ndarray, w: np.ndarray, n: np.ndarray, shards: int) -> list[tuple]:
    """(shard, names, v, w, n) of sorted bigram counts: codes into the shard's own dictionary."""
    shard = _top(pair_hash(v, w), shards)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[s] : ends[s + 1]]
        names, code = np.unique(np.concatenate([v[at], w[at]]), return_inverse=True)
        code = code.astype(np.uint32)
        first = np.diff(code[: len(at)], prepend=np.uint32(0)).astype(np.uint32)  # v is sorted
        rows.append((s, names.tobytes(), _planes(first), _planes(code[len(at) :]), _planes(n[at].astype(np.uint32))))
    return rows


def _counts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigram counts of blobs, added up."""
    vs, ws, ns = [], [], []
    for i in range(t.num_rows):
        names = np.frombuffer(t.column("names")[i].as_py(), np.uint64)
        vs.append(names[np.cumsum(_unplanes(t.column("v")[i].as_py(), np.uint32), dtype=np.int64)])
        ws.append(names[_unplanes(t.column("w")[i].as_py(), np.uint32)])
        ns.append(_unplanes(t.column("n")[i].as_py(), np.uint32).astype(np.int64))
    return _sum_pairs(np.concatenate(vs), np.concatenate(ws), np.concatenate(ns))


_BLOB = [("names", pa.binary()), ("v", pa.binary()), ("w", pa.binary()), ("n", pa.binary())]
_BLOB_SCHEMA = "names binary, v binary, w binary, n binary"


def _count(docs: DataFrame, text: str, shards: int, parts: int) -> DataFrame:
    """(shard, part, names, v, w, n) blobs of bigram counts; ``part`` is one of ``parts`` groups of tasks."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % parts
        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), *_BLOB])

        def send(held):
            v, w, n = _sum_pairs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), None)
            cols = list(zip(*((s, part, *rest) for s, *rest in _blobs(v, w, n, shards)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        held, size = [], 0
        for b in batches:
            for x in words(b.column(0)):
                v, w, _ = _bigrams(x)
                held.append((v, w))
                size += len(v)
                if size >= FLUSH:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return docs.select(text).mapInArrow(run, f"shard int, part int, {_BLOB_SCHEMA}")


def _split(blobs: DataFrame, shards: int) -> DataFrame:
    """Blobs of few wide shards, added up within a group of tasks, as blobs of the final shards.

    With the square root of the shards as wide ones, and of the tasks as groups, T tasks and S shards exchange
    T sqrt(S) + S sqrt(T) blobs instead of T S.
    """

    def run(t: pa.Table) -> pa.Table:
        cols = list(zip(*_blobs(*_counts(t), shards), strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", *(n for n, _ in _BLOB)])

    return blobs.groupBy("shard", "part").applyInArrow(run, f"shard int, {_BLOB_SCHEMA}")


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One file of several arrays: the length of a JSON header, the header, the arrays at multiples of 64 bytes."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    header = json.dumps(head).encode()
    out = io.BytesIO()
    out.write(len(header).to_bytes(8, "little") + header)
    begin = -(-out.tell() // 64) * 64
    for k, a in arrays.items():
        out.seek(begin + head[k][1])
        out.write(np.ascontiguousarray(a).tobytes())
    store_bytes(f"{folder}/{name}", out.getvalue())


def _load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; none where there is no file."""
    data = mapped_file(path)
    if data is None:
        return {}
    size = int.from_bytes(data[:8].tobytes(), "little")
    begin = -(-(8 + size) // 64) * 64
    out = {}
    for k, (kind, at, n) in json.loads(data[8 : 8 + size].tobytes()).items():
        dtype = np.dtype(kind)
        out[k] = data[begin + at : begin + at + n * dtype.itemsize].view(dtype)
    return out


def _merge_bigrams(blobs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes each shard's sorted bigrams; gives (shard, names, stats) blobs of word statistics."""
    # Words are fewer than bigrams: the wide shards have them, so that blobs stay few.
    wide = _wide(shards)

    def run(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        v, w, n = _counts(t)
        key = pair_hash(v, w)
        order = np.argsort(key)
        small = np.minimum(n, 255).astype(np.uint8)
        large = order[n[order] >= 255]
        _save(folder, f"bigrams-{s}", key=key[order], n=small[order], large_key=key[large], large_n=n[large])
        names, code = np.unique(np.concatenate([v, w]), return_inverse=True)
        a, b = code[: len(v)], code[len(v) :]
        add = lambda at, weight=None: np.bincount(at, weight, len(names)).astype(np.int64)
        stats = [add(b, n), add(b), *(add(a[n == k]) for k in (1, 2, 3, 4)), add(a[n >= 3])]
        begin = np.flatnonzero(names == BEGIN)
        if len(begin):  # the begin is never predicted; its tokens are its followers
            stats[0][begin] = n[v == BEGIN].sum()
        place = _top(names, wide)
        ends = np.searchsorted(place, np.arange(wide + 1))
        rows = [(k, names[lo:hi].tobytes(), b"".join(len(p).to_bytes(8, "little") + p for p in (_planes(x[lo:hi]) for x in stats))) for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if hi > lo]
        cols = list(zip(*rows, strict=True))
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "names": pa.array(cols[1], pa.binary()), "stats": pa.array(cols[2], pa.binary())})

    return blobs.groupBy("shard").applyInArrow(run, "shard int, names binary, stats binary")


_TOTALS = ("tokens", "types", "before", "b1", "b2", "b3", "b4", "b3up", "f1", "f2", "f3", "f4", "f3up")


def _merge_words(blobs: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's sorted words; gives its totals."""

    def run(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        names = [np.frombuffer(x, np.uint64) for x in t.column("names").to_pylist()]
        stats = []
        for x in t.column("stats").to_pylist():
            cols, at = [], 0
            while at < len(x):
                size = int.from_bytes(x[at : at + 8], "little")
                cols.append(_unplanes(x[at + 8 : at + 8 + size], np.int64))
                at += 8 + size
            stats.append(cols)
        h, code = np.unique(np.concatenate(names), return_inverse=True)
        sums = {}
        for i, c in enumerate(COLUMNS):
            total = np.zeros(len(h), np.int64)
            np.add.at(total, code, np.concatenate([x[i] for x in stats]))
            sums[c] = total
        _save(folder, f"words-{s}", hash=h, tokens=sums["tokens"], **{c: sums[c].astype(np.uint32) for c in ("before", "f1", "f2", "f3up")})
        said = (h != BEGIN) & (sums["tokens"] > 0)
        b = sums["before"][said]
        totals = {"tokens": sums["tokens"][said].sum(), "types": said.sum(), "before": b.sum(), "b3up": (b >= 3).sum()}
        totals |= {f"b{k}": (b == k).sum() for k in (1, 2, 3, 4)} | {c: sums[c].sum() for c in COLUMNS[2:]}
        return pa.table({c: pa.array([int(totals[c])], pa.int64()) for c in _TOTALS})

    return blobs.groupBy("shard").applyInArrow(run, ", ".join(f"{c} long" for c in _TOTALS))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+; where a count of counts is missing, k - 1/2 for the k-th."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.01, k - 0.01)) if a and b and y else k - 0.5 for k, a, b in pairs)


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int  # of the bigrams
    word_shards: int
    totals: dict[str, int]

    @property
    def tokens(self) -> int:
        return self.totals["tokens"]

    @property
    def types(self) -> int:
        return self.totals["types"]


#: Up to so many shards, tasks send their counts to the final shards at once; beyond it by way of wide ones. The
#: model is the same.
ONE_LEVEL = 512


def _wide(shards: int) -> int:
    return shards if shards <= ONE_LEVEL else max(ONE_LEVEL, 1 << ((shards.bit_length() - 1) // 2))


def fit(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count all texts of ``docs``. The number of shards follows the number of input partitions."""
    spark = docs.sparkSession
    tasks = docs.select(text).rdd.getNumPartitions()
    shards = 1 << (max(1, shards or max(8, tasks)) - 1).bit_length()
    folder = new_path(spark, "kneser-ney")
    wide = _wide(shards)
    blobs = _count(docs, text, wide, max(1, int(tasks**0.5)))
    if wide < shards:
        blobs = _split(blobs, shards)
    # Totals alone come to the driver.
    found = _merge_words(_merge_bigrams(blobs, folder, shards), folder).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _TOTALS)).first()
    return Model(folder, shards, wide, found.asDict())


#: Files that a process has mapped at a time.
KEPT = 1024


class Mapped:
    """A model's files, mapped by one process, the last used ones of them."""

    def __init__(self, m: Model):
        self.m = m
        self.files: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
        t = m.totals
        self.d = np.array([0.0, *discounts(t["f1"], t["f2"], t["f3"], t["f4"])])
        self.e = np.array([0.0, *discounts(t["b1"], t["b2"], t["b3"], t["b4"])])
        before = t["before"]
        spare = (self.e[1] * t["b1"] + self.e[2] * t["b2"] + self.e[3] * t["b3up"]) / before if before else 1.0
        self.unknown = spare / (m.types + 1)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.files:
            while len(self.files) >= KEPT:
                self.files.popitem(last=False)
            self.files[name] = _load(f"{self.m.folder}/{name}")
        self.files.move_to_end(name)
        return self.files[name]

    def _find(self, kind: str, column: str, shards: int, h: np.ndarray):
        """For sorted hashes, shard after shard: its arrays, places in h, and their places in the shard's sorted hashes (found ones only)."""
        ends = np.searchsorted(_top(h, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)).tolist():
            lo, hi = ends[s], ends[s + 1]
            arrays = self.arrays(f"{kind}-{s}")
            if arrays:
                keys = arrays[column]
                at = np.searchsorted(keys, h[lo:hi])
                at[at == len(keys)] = 0
                ok = np.flatnonzero(keys[at] == h[lo:hi])
                yield arrays, lo + ok, at[ok]

    def word_stats(self, h: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: np.zeros(len(h), np.int64) for c in ("tokens", "before", "f1", "f2", "f3up")}
        for arrays, i, at in self._find("words", "hash", self.m.word_shards, h):
            for c, x in out.items():
                x[i] = arrays[c][at]
        return out

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        h = keys[order]
        n = np.zeros(len(h), np.int64)
        for arrays, i, at in self._find("bigrams", "key", self.m.shards, h):
            n[i] = arrays["n"][at]
            big = i[n[i] == 255]
            if len(big):
                n[big] = arrays["large_n"][np.searchsorted(arrays["large_key"], h[big])]
        out = np.empty(len(h), np.int64)
        out[order] = n
        return out

    def log_probabilities(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(w | v) and the training tokens of w, of each token."""
        names, code = np.unique(np.concatenate([v, w]), return_inverse=True)
        a, b = code[: len(v)], code[len(v) :]
        x = self.word_stats(names)
        t = self.m.totals
        before = np.where(names == BEGIN, 0, x["before"])
        p1 = self.unknown + (before - self.e[np.minimum(before, 3)]) / max(t["before"], 1)
        n = x["tokens"]
        spare = np.where(n > 0, (self.d[1] * x["f1"] + self.d[2] * x["f2"] + self.d[3] * x["f3up"]) / np.maximum(n, 1), 1.0)
        spare[names == END] = 1.0  # the end has no followers
        c = self.bigram_counts(pair_hash(v, w))
        p = np.where(c > 0, (c - self.d[np.minimum(c, 3)]) / np.maximum(n[a], 1), 0.0) + spare[a] * p1[b]
        return np.log10(p), n[b]


_mapped: OrderedDict[str, Mapped] = OrderedDict()


def mapped(m: Model) -> Mapped:
    if m.folder not in _mapped:
        while len(_mapped) >= 2:
            _mapped.popitem(last=False)
        _mapped[m.folder] = Mapped(m)
    return _mapped[m.folder]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and perplexity."""

    def make():
        m = mapped(model)  # kept between the tasks of a worker
        total, types = model.tokens, model.types

        def fn(texts: pa.Array) -> list[pa.Array]:
            out = np.zeros((4, len(texts)))
            for x in words(texts):
                v, w, doc = _bigrams(x)
                lp, c = m.log_probabilities(v, w)
                base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
                to = slice(x.first, x.first + x.n_docs)
                for k, y in enumerate((np.ones(len(v)), c > 0, base, lp)):
                    out[k, to] = np.bincount(doc, y, x.n_docs)
            ints = out[:2].astype(np.int64)
            return [pa.array(ints[0]), pa.array(ints[1]), pa.array(np.full(len(texts), total, np.int64)), pa.array(out[2]), pa.array(out[3]), pa.array(10 ** (-out[3] / out[0]))]

        return fn

    long, double = T.LongType(), T.DoubleType()
    names = (("n_tokens", long), ("n_known", long), ("train_tokens", long), ("base_score", double), ("score", double), ("perplexity", double))
    return append_arrow(docs, text, [T.StructField(n, t) for n, t in names], make)


