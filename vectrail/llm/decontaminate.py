"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark is normalised to words of letters and digits. Each of its n-grams is a seed; how rare a seed is
by chance comes from the corpus frequencies of its words, counted over all documents: a seed is used if its
expected number of chance occurrences in a million corpus tokens is at most ``chance``. An item with fewer than
``least_seeds`` of them is searched by all its n-grams, common ones too. How often a seed really occurs doesn't matter, so a test item that
was copied into very many documents stays detectable. Documents are joined with the seeds by hash; around the
places of an item's seeds the document's words are aligned locally with the item's words, and the score is the
alignment's share of a perfect match.

The benchmark is sent to all workers if its text has at most ``BROADCAST_BYTES``; a larger one is taken in
blocks of that size, two passes over the documents for each block (word frequencies, search). Documents are never shuffled.

Cases: null or empty texts and items match nothing; an item of fewer words than a seed is one seed of all its
words; equal items are reported each; equal rows of documents are reported each; ties between windows of one
document take the first; a null id is reported with its null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix, pair_hash, words
from .common import append_arrow

_U = np.uint64
BROADCAST_BYTES = 16 << 20
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    seed_words: int = 3
    chance: float = 2.0  # expected chance occurrences of a seed in a million tokens
    least_seeds: int = 8  # an item with fewer rare seeds is searched by all its n-grams
    match: float = 1.0
    mismatch: float = -0.6
    gap: float = -0.6
    threshold: float = 0.45  # of a perfect alignment
    least_words: int = 5  # shorter items are matched whole


def split_words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _hash_words(found: list[str]) -> np.ndarray:
    """64-bit word hashes. Python's own hash differs between processes, so the bytes are hashed by the batch."""
    if not found:
        return np.empty(0, np.uint64)
    return np.concatenate([w.hash for w in words(pa.array([" ".join(found)], pa.large_string()), fold_case=False)])


#: Bytes of words: ASCII letters and digits, and all beyond ASCII; runs with the latter are split further as text.
_RUN = np.zeros(256, dtype=bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = _RUN[128:] = True
#: Runs beyond ASCII whose words are kept at a time.
_KEPT = 1 << 18


def hashed_texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, bounds of each document's words) of a column: the words of ``split_words``.

    An ASCII run is a word and has its hash already. The others are split as text, each distinct one once.
    """
    known: dict[int, np.ndarray] = {}
    for w in words(texts, letters=_RUN):
        hashes, bounds = w.hash, w.bounds
        beyond = np.flatnonzero(np.bitwise_or.reduceat(w.data, w.start) >> 7) if len(w.start) else w.start
        if len(beyond):
            # Runs of one hash differ in the case of ASCII letters at the most, and so have the same words.
            runs, first, which = np.unique(hashes[beyond], return_index=True, return_inverse=True)
            if len(known) > _KEPT:
                known.clear()
            new = [(k, i) for k, i in zip(runs.tolist(), beyond[first].tolist(), strict=True) if k not in known]
            found = [split_words(w.data[w.start[i] : w.end[i]].tobytes().decode()) for _, i in new]
            ends = np.cumsum([0, *map(len, found)])
            fresh = _hash_words([x for f in found for x in f])
            known.update((k, fresh[lo:hi]) for (k, _), lo, hi in zip(new, ends[:-1], ends[1:], strict=True))
            parts = [known[k] for k in runs.tolist()]
            size = np.array([len(p) for p in parts])
            begin = np.cumsum(size) - size
            n = np.ones(len(hashes), np.int64)
            n[beyond] = size[which]
            to = np.cumsum(n) - n
            out = np.repeat(hashes, n)
            step = np.arange(int(n[beyond].sum())) - np.repeat(np.cumsum(n[beyond]) - n[beyond], n[beyond])
            out[np.repeat(to[beyond], n[beyond]) + step] = np.concatenate(parts)[np.repeat(begin[which], n[beyond]) + step]
            hashes, bounds = out, np.append(0, np.cumsum(n))[bounds]
        yield w.first, hashes, bounds


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        n = len(h)
    out = h[: len(h) - n + 1].copy() if n else h
    for k in range(1, n):
        out = pair_hash(out, h[k : len(h) - n + 1 + k])
    return mix(out ^ _U(n))


def align(a: np.ndarray, b: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """Best local alignment of words a (the item) in b: score, first and last+1 place in b.

    One row per item word; gaps along a row come from a running maximum.
    """
    m = len(b)
    steps = s.gap * np.arange(m + 1)
    row = np.zeros(m + 1)
    begin = np.arange(m + 1)
    best, span = 0.0, (0, 0)
    at = np.arange(m + 1)
    for x in a:
        diag = row[:-1] + np.where(b == x, s.match, s.mismatch)
        up = row + s.gap
        new = np.maximum(up, 0.0)
        start = np.where(up > 0, begin, at)
        better = diag > new[1:]
        new[1:] = np.where(better, diag, new[1:])
        start[1:] = np.where(better, begin[:-1], start[1:])
        level = new - steps
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, at, 0))
        new = top + steps
        start = start[source]
        row, begin = np.maximum(new, 0.0), np.where(new > 0, start, at)
        j = int(row.argmax())
        if row[j] > best:
            best, span = float(row[j]), (int(begin[j]), j)
    return best, *span


class Index:
    """A block of the benchmark: item words, and seeds as sorted hashes with their items and places."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, float], s: Settings):
        self.s = s
        self.ids, self.words = [], []
        seeds, owner, place = [], [], []
        for item_id, text in items:
            found = split_words(text)
            if not found:
                continue
            h = _hash_words(found)
            grams = _ngrams(h, s.seed_words)
            p = np.array([frequency.get(w, 0.0) for w in found])
            n = min(s.seed_words, len(found))
            expected = 1e6 * np.array([np.prod(p[i : i + n]) for i in range(len(grams))])
            order = np.argsort(expected, kind="stable")
            rare = int((expected <= s.chance).sum())
            used = order[:rare] if rare >= s.least_seeds else order
            seeds.append(grams[used])
            owner.append(np.full(len(used), len(self.ids)))
            place.append(used)
            self.ids.append(item_id)
            self.words.append(h)
        flat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        seeds, owner, place = flat(seeds, np.uint64), flat(owner, np.int64), flat(place, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.lengths = sorted({min(s.seed_words, len(w)) for w in self.words})

    def find(self, h: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, end word, seeds) of the items in a text, given its word hashes."""
        if not len(h) or not len(self.seeds):
            return []
        hits: dict[int, list[int]] = {}
        for n in self.lengths:
            if len(h) < n:
                continue
            grams = _ngrams(h, n)
            lo = np.searchsorted(self.seeds, grams, "left")
            there = np.flatnonzero((lo < len(self.seeds)) & (self.seeds[np.minimum(lo, len(self.seeds) - 1)] == grams))
            for at in there.tolist():
                k = int(lo[at])
                while k < len(self.seeds) and self.seeds[k] == grams[at]:
                    hits.setdefault(int(self.owner[k]), []).append(at - int(self.place[k]))
                    k += 1
        out = []
        for item, offsets in sorted(hits.items()):
            if best := self._best(item, h, sorted(offsets)):
                out.append((self.ids[item], *best, len(offsets)))
        return out

    def _best(self, item: int, h: np.ndarray, offsets: list[int]) -> tuple[float, int, int] | None:
        words, s = self.words[item], self.s
        n = len(words)
        slack = n // 2 + 2
        known, best = set(words.tolist()), None
        i = 0
        while i < len(offsets):  # neighbouring places of the item share a window
            j = i
            while j + 1 < len(offsets) and offsets[j + 1] - offsets[j] <= slack:
                j += 1
            lo, hi = max(0, offsets[i] - slack), min(len(h), offsets[j] + n + slack)
            i = j + 1
            window = h[lo:hi]
            # No alignment scores more than a match for each item word that the window has.
            present = set(window.tolist()) & known
            if sum(w in present for w in words.tolist()) * s.match < s.threshold * s.match * n:
                continue
            got, a, b = align(words, window, s)
            score = min(1.0, round(got / (s.match * n), 6))
            if score >= (s.threshold if n >= s.least_words else 1.0) and (best is None or score > best[0]):
                best = (score, lo + a, lo + b)
        return best


def _frequencies(docs: DataFrame, text: str, vocabulary: set[str]) -> dict[str, float]:
    """Share of all corpus tokens of each benchmark word, over all documents; tasks send one row per word."""
    names = sorted(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        names = shared.value
        keys = _hash_words(names)
        order = np.argsort(keys)
        keys = keys[order]
        counts, total = np.zeros(len(names), np.int64), 0
        for b in batches:
            for _, h, _ in hashed_texts(b.column(0)):
                total += len(h)
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = at[keys[at] == h] if len(keys) else at[:0]
                counts += np.bincount(hit, minlength=len(names))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(order[at], -1)), pa.array(np.append(counts[at], total))], names=["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the words of the benchmark block
    found = {r["word"]: r["n"] for r in rows}
    total = max(1, found.pop(-1, 0) or 1)
    return {names[i]: n / total for i, n in found.items()}


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, one at a time; at least one, which may be empty."""
    block, size = [], 0
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = len(r["t"].encode())
        if block and size + n > BROADCAST_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per document and item found in it: the key, item, score in 0..1, words [begin, end) and seeds."""
    s = settings or Settings()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for block in _blocks(benchmark, item, item_text):
        vocabulary = {w for _, t in block for w in split_words(t)}
        index = Index(block, _frequencies(docs, text, vocabulary), s)
        parts.append(_scan(rows, docs.sparkSession.sparkContext.broadcast(index)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scan(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        index = shared.value
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for first, h, bounds in hashed_texts(b.column(1)):
                for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
                    out += [(ids[k], *x) for x in index.find(h[lo:hi])]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "begin", "end", "n_seeds"])

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, begin long, end long, n_seeds long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; columns as they were."""
    found = contaminated(docs, benchmark, key, text, settings=settings).select(F.col("doc_id").alias("__leak")).where(F.col("__leak").isNotNull()).distinct()
    return docs.join(found, F.col(key) == F.col("__leak"), "left_anti")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` in whose own text no benchmark item is found, whatever their id; columns as they were."""
    s = settings or Settings()
    out = docs
    for block in _blocks(benchmark, item, item_text):
        vocabulary = {w for _, t in block for w in split_words(t)}
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, _frequencies(docs, text, vocabulary), s))
        out = _unmatched(out, text, shared)
    return out


def _unmatched(docs: DataFrame, text: str, shared) -> DataFrame:
    def make():
        index = shared.value

        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([bool(index.find(h[lo:hi])) for _, h, bounds in hashed_texts(texts) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.bool_())]

        return fn

    return append_arrow(docs, text, [T.StructField("__leak", T.BooleanType())], make).where(~F.col("__leak")).drop("__leak")
