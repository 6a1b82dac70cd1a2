"""Chunkers: text to (chunk_index, chunk) rows. Lengths are code points."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


class Chunker(Protocol):
    def chunk(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with one row per chunk: ``chunk_index`` and ``chunk`` in place of the text."""


def _explode(docs: DataFrame, text: str, chunks: Column) -> DataFrame:
    return docs.select(*(c for c in docs.columns if c != text), F.posexplode(chunks).alias("chunk_index", "chunk"))


def fixed_slices(text: Column, size: int) -> Column:
    n = F.char_length(text)
    at = F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)
    return F.when(n > 0, F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sliding_slices(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` that start ``size - overlap`` apart, up to the first that reaches the end."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    n, step = F.char_length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def counts(chunker: Chunker, docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the number of their chunks in place of the text; rows that are alike count once or more often.

    A chunker that has ``count`` tells it without chunking.
    """
    rest = [c for c in docs.columns if c != text]
    if hasattr(chunker, "count"):
        return docs.select(*rest, chunker.count(F.col(text)).cast("long").alias(out))
    made = chunker.chunk(docs, text).select(*rest, (F.col("chunk_index") + 1).cast("long").alias(out))
    return docs.select(*rest, F.lit(0).cast("long").alias(out)).unionByName(made).groupBy(*rest).agg(F.max(out).alias(out))


class Fixed:
    def __init__(self, size: int = 500):
        self.size = size

    def count(self, text: Column) -> Column:
        return F.ceil(F.char_length(text) / self.size)

    def chunk(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return _explode(docs, text, fixed_slices(F.col(text), self.size))


class Sliding:
    def __init__(self, size: int = 500, overlap: int = 100):
        if overlap >= size:
            raise ValueError("the overlap must be smaller than the size")
        self.size, self.overlap = size, overlap

    def chunk(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return _explode(docs, text, sliding_slices(F.col(text), self.size, self.overlap))


def pack(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Pieces of at most ``size``, split at the first separator that helps, with parts carried over as overlap.

    Parts are packed greedily. When a part doesn't fit, the packed ones are given out, and as many of their
    last parts as fit in ``overlap`` begin the next piece, whatever its length then becomes: a piece is at most
    size + overlap + a separator long. A part longer than ``size`` is split by the separators that remain.
    """
    if len(text) <= size:
        return [text]
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    sep, rest = separators[0], separators[1:]
    out: list[str] = []
    held: list[str] = []
    length = 0  # of the held parts when joined
    for part in text.split(sep) if sep else text:
        if len(part) > size:
            if held:
                out.append(sep.join(held))
            held, length = [], 0
            out += pack(part, size, overlap, rest)
        elif not held or length + len(sep) + len(part) <= size:
            length += len(part) + (len(sep) if held else 0)
            held.append(part)
        else:
            out.append(sep.join(held))
            begin, spent = len(held), 0
            while begin and spent + len(held[begin - 1]) <= overlap:
                begin -= 1
                spent += len(held[begin]) + len(sep)
            held = [*held[begin:], part]
            length = sum(map(len, held)) + len(sep) * (len(held) - 1)
    return [*out, sep.join(held)] if held else out


class Recursive:
    """Greedy packing is sequential within a text, so it runs in Arrow batches, many texts at a time."""

    def __init__(self, size: int = 500, overlap: int = 100, separators: Sequence[str] = ("\n\n", "\n", " ", "")):
        self.size, self.overlap, self.separators = size, overlap, tuple(separators)

    def chunk(self, docs: DataFrame, text: str = "text") -> DataFrame:
        size, overlap, separators = self.size, self.overlap, self.separators

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def split(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [] if t is None else pack(t, size, overlap, separators))

        return _explode(docs, text, split(F.col(text)))


class Semantic:
    """Neighbouring sentences stay together while the similarity of their vectors is at least ``threshold``.

    A row holds all its sentences, so it is split, embedded, compared and joined where it is: no shuffle, and rows
    that share an id stay apart.
    """

    def __init__(self, embedder, threshold: float = 0.75):
        self.embedder, self.threshold = embedder, threshold

    def chunk(self, docs: DataFrame, text: str = "text") -> DataFrame:
        embedder, threshold = self.embedder, self.threshold
        rest = [f for f in docs.schema.fields if f.name != text]
        names = [f.name for f in rest]
        sentences = F.coalesce(X.sentences(F.col(text)), F.array().cast("array<string>"))
        rows = docs.select(*(F.col(f"`{n}`") for n in names), sentences.alias("__s"))
        rows = rows.select("*", F.transform("__s", embedder.prepared).alias("__p"))

        def run(batches):
            for b in batches:
                said, lengths = b.column(len(names)).flatten().to_pylist(), pc.list_value_length(b.column(len(names))).to_numpy(zero_copy_only=False)
                if not said:
                    continue
                v = embedder.vectors(b.column(len(names) + 1).flatten())
                n = np.sqrt((v * v).sum(1))
                size = n[1:] * n[:-1]
                near = np.round(np.where(size > 0, (v[1:] * v[:-1]).sum(1) / np.where(size > 0, size, 1.0), 0.0), 9)  # equal on every engine
                row = np.repeat(np.arange(b.num_rows), lengths)
                apart = np.append(True, (row[1:] != row[:-1]) | (near < threshold))
                begin = np.flatnonzero(apart)
                owner = row[begin]
                index = np.arange(len(begin)) - np.searchsorted(owner, owner)
                chunks = [" ".join(said[i:j]) for i, j in zip(begin, [*begin[1:], len(said)], strict=True)]
                kept = [c.take(pa.array(owner)) for c in b.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(chunks, pa.string())], names=[*names, "chunk_index", "chunk"])

        return rows.mapInArrow(run, T.StructType([*rest, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())]))
