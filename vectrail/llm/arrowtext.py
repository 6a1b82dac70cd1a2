"""Words and their 64-bit hashes for whole batches of texts, in numpy over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE, slices

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd word per byte value; A-Z share those of a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[ord(c) for c in SPACE]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ _U(0xA0761D6478BD642F)))


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


class Words(NamedTuple):
    first: int  # index of the batch's first document in the column
    n_docs: int
    doc: np.ndarray  # document of each word, counted from ``first``
    hash: np.ndarray  # uint64 of each word
    bounds: np.ndarray  # words of document i: bounds[i]:bounds[i+1]
    start: np.ndarray  # byte range of each word, from the batch's first byte
    end: np.ndarray
    data: np.ndarray  # bytes
    doc_start: np.ndarray  # byte offsets of the documents, n_docs + 1


def byte_ranges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets


def words(texts: pa.Array, fold_case: bool = True, chunk: int = CHUNK, letters: np.ndarray = _IS_WORD) -> Iterator[Words]:
    """Words of each text, a bounded number of bytes at a time: runs of the bytes in ``letters``. Nulls have no words."""
    raw, offsets = byte_ranges(texts)
    table = _BYTE_FOLDED if fold_case else _BYTE
    for lo, hi in slices(np.diff(offsets), chunk):
        off = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        n = len(data)
        if not n:
            e = np.empty(0, np.int64)
            yield Words(lo, hi - lo, e, np.empty(0, np.uint64), np.zeros(hi - lo + 1, np.int64), e, e, data, off)
            continue
        inside = letters[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if len(start):
            longest = int((end - start).max())
            head = int(start[0])
            place = np.arange(head, n) - np.repeat(start, np.diff(np.append(start, n)))
            values = table[data[head:]]
            values[~inside[head:]] = 0
            values *= _pow(longest).take(place, mode="clip")
            hashed = mix(np.add.reduceat(values, start - head) ^ ((end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
        else:
            hashed = np.empty(0, np.uint64)
        bounds = np.searchsorted(start, off)
        doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
        yield Words(lo, hi - lo, doc, hashed, bounds, start, end, data, off)
