"""HTML extraction: a bidirectional LSTM in numpy labels each leaf block of a page as article or not.

A block's vector joins hashed tag-path names, hashed words and a few numbers (length, links, place). The
LSTM reads a page's whole sequence in both directions, so each label uses document-wide context. It is
trained on pages made by rule (``html_training``), with a fixed seed, and sent to the workers (its size is fixed).

Cases: a null or empty page gives an empty text and 0 code points, as does one without blocks or without
article blocks; unclosed, unknown or cut-off markup is read to the end; equal rows give equal results; other
columns stay. A page is one sequence, however long; pages are batched by their number of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import words
from .common import append_arrow
from .html_blocks import PLACES, Block, blocks
from .html_training import Maker

PATH, WORDS, NUMBERS = PLACES, 48, 10
#: Blocks (with padding) that are labelled at once, unless one page has more.
STEP = 8192


@dataclass(frozen=True)
class Settings:
    hidden: int = 20
    pages: int = 500
    epochs: int = 10
    batch: int = 20
    rate: float = 0.01
    seed: int = 11


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block of all pages, in order."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), PATH + WORDS + NUMBERS), np.float32)
    if not flat:
        return out
    texts = pa.array([b.text for b in flat], pa.large_string())
    for w in words(texts):
        place = (w.hash >> np.uint64(40)) % np.uint64(WORDS)
        n = np.bincount(w.doc * WORDS + place.astype(np.int64), minlength=w.n_docs * WORDS).reshape(-1, WORDS)
        out[w.first : w.first + w.n_docs, PATH : PATH + WORDS] = n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1)
        out[w.first : w.first + w.n_docs, PATH + WORDS] = np.log1p(np.diff(w.bounds)) / 5
    mask = b"".join(b.path.places.to_bytes(PATH // 8, "little") for b in flat)
    out[:, :PATH] = np.unpackbits(np.frombuffer(mask, np.uint8).reshape(len(flat), -1), axis=1, bitorder="little")
    at = 0
    for p in pages:
        total = max(1, sum(len(b.text) for b in p))
        for i, b in enumerate(p):
            n = len(b.text)
            out[at, PATH + WORDS + 1 :] = (
                np.log1p(n) / 8, b.link, i / len(p), 1.0 - i / len(p), n / total, b.path.length / 12,
                float(b.path.last in ("p", "li", "td", "blockquote", "pre", "dd")), float(b.path.heading), float(b.text[-1] in ".!?:;\"»”"),
            )
            at += 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Bidirectional LSTM with one output per block; weights in ``w``."""

    def __init__(self, hidden: int, seed: int):
        r, d = np.random.default_rng(seed), PATH + WORDS + NUMBERS
        self.h = hidden
        self.w: dict[str, np.ndarray] = {}
        for k in "fb":
            self.w[f"x{k}"] = (r.standard_normal((d, 4 * hidden)) * 0.15).astype(np.float32)
            self.w[f"h{k}"] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0  # of the forget gate
            self.w[f"b{k}"] = bias
        self.w["o"] = (r.standard_normal(2 * hidden) * 0.3).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, n: np.ndarray, k: str, keep: bool):
        """States of one direction over padded sequences (batch, steps, inputs)."""
        b, t, _ = x.shape
        h, c = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
        z = x @ self.w[f"x{k}"] + self.w[f"b{k}"]
        out, trace, s = np.zeros((b, t, self.h), np.float32), [], self.h
        for i in range(t):
            a = z[:, i] + h @ self.w[f"h{k}"]
            g, f, o, u = _sigmoid(a[:, :s]), _sigmoid(a[:, s : 2 * s]), _sigmoid(a[:, 2 * s : 3 * s]), np.tanh(a[:, 3 * s :])
            c2 = f * c + g * u
            tc = np.tanh(c2)
            on = (i < n)[:, None]
            if keep:
                trace.append((h, c, g, f, o, u, tc, on))
            h, c = np.where(on, o * tc, h), np.where(on, c2, c)
            out[:, i] = h
        return out, trace

    @staticmethod
    def _flip(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each sequence's own steps in reverse; the padding stays behind."""
        i = np.arange(x.shape[1])[None, :]
        at = np.where(i < n[:, None], n[:, None] - 1 - i, i)
        return np.take_along_axis(x, at[:, :, None], 1)

    def logits(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, n, "f", keep)
        xb = self._flip(x, n)
        hb, tb = self._run(xb, n, "b", keep)
        both = np.concatenate([hf, self._flip(hb, n)], 2)
        z = both @ self.w["o"] + self.w["c"][0]
        return (z, both, (x, tf), (xb, tb)) if keep else z

    def _back(self, d: np.ndarray, x: np.ndarray, trace: list, k: str, grad: dict) -> None:
        s = self.h
        dh, dc = np.zeros((len(x), s), np.float32), np.zeros((len(x), s), np.float32)
        da = np.zeros((*x.shape[:2], 4 * s), np.float32)
        for i in range(len(trace) - 1, -1, -1):
            h, c, g, f, o, u, tc, on = trace[i]
            dh = dh + d[:, i]
            dh2 = np.where(on, dh, 0)
            dc2 = np.where(on, dc, 0) + dh2 * o * (1 - tc * tc)
            a = np.concatenate([dc2 * u * g * (1 - g), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * g * (1 - u * u)], 1)
            da[:, i] = a
            grad[f"h{k}"] += h.T @ a
            dh = np.where(on, a @ self.w[f"h{k}"].T, dh)
            dc = np.where(on, dc2 * f, dc)
        flat = da.reshape(-1, 4 * s)
        grad[f"x{k}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"b{k}"] += flat.sum(0)

    def train(self, x: list[np.ndarray], y: list[np.ndarray], s: Settings) -> None:
        r = np.random.default_rng(s.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(s.epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(order), s.batch):
                own = order[lo : lo + s.batch]
                xs, n = pad([x[i] for i in own])
                if r.random() < 0.5:  # names and words that weren't seen
                    xs = xs * (r.random((len(own), 1, xs.shape[2])) > 0.1)
                    xs = xs.astype(np.float32)
                ys, _ = pad([y[i][:, None] for i in own])
                z, both, f, b = self.logits(xs, n, keep=True)
                on = np.arange(xs.shape[1])[None, :] < n[:, None]
                d = (np.where(on, _sigmoid(z) - ys[:, :, 0], 0) / max(1, on.sum())).astype(np.float32)
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                grad["o"] = (both * d[:, :, None]).sum((0, 1))
                grad["c"] = np.array([d.sum()], np.float32)
                dboth = d[:, :, None] * self.w["o"]
                self._back(dboth[:, :, : self.h], *f, "f", grad)
                self._back(self._flip(dboth[:, :, self.h :], n), *b, "b", grad)
                step += 1
                rate = s.rate * (1 - 0.9 * epoch / s.epochs)
                for k, g in grad.items():
                    g = np.clip(g + 1e-5 * self.w[k], -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article."""
        x = features(pages)
        ends = np.cumsum([0, *map(len, pages)])
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= STEP:
                hi += 1
            xs, n = pad([x[ends[i] : ends[i + 1]] for i in order[lo:hi]])
            z = self.logits(xs, n)
            for k, i in enumerate(order[lo:hi]):
                out[i] = z[k, : n[k]] > 0
            lo = hi
        return out


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), n.max(), seqs[0].shape[1]), np.float32)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, n


def labelled_pages(count: int, seed: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    maker = Maker(seed)
    pages, labels = [], []
    for _ in range(count):
        found = blocks(maker.page())
        if found:
            labels.append(np.array([Maker.MARK in b.text for b in found], np.float32))
            pages.append([b._replace(text=" ".join(b.text.replace(Maker.MARK, "").split()) or "x") for b in found])
    return pages, labels


@lru_cache(maxsize=2)
def trained(settings: Settings) -> Labeller:
    pages, labels = labelled_pages(settings.pages, settings.seed)
    x = features(pages)
    ends = np.cumsum([0, *map(len, pages)])
    model = Labeller(settings.hidden, settings.seed)
    model.train([x[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], labels, settings)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return [" ".join(b.text for b, ok in zip(f, keep, strict=True) if ok) for f, keep in zip(found, model.label(found), strict=True)]


def extract(pages: DataFrame, html: str = "html", settings: Settings | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(settings or Settings()))

    def make():
        def fn(column: pa.Array) -> list[pa.Array]:
            out, part, size = [], [], 0
            for p in column:  # a bounded number of characters at a time
                part.append(p.as_py())
                size += len(part[-1] or "")
                if size > 1 << 22:
                    out += main_texts(part, shared.value)
                    part, size = [], 0
            out += main_texts(part, shared.value)
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return fn

    return append_arrow(pages, html, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
