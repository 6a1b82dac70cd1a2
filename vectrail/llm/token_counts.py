"""Token counts of byte-level BPE vocabularies, as the ``tokenizers`` library gives them.

Texts are split into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a batch lie as
ragged numpy arrays (symbols of all sequences end to end). In each round every sequence's lowest-rank pair
is merged at all its places at once, for all sequences together; a sequence without a pair of known rank
is done, and its surviving symbols are its tokens.

Cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are one token each, as
the library's default has it; there is no truncation. Any number of rows and equal rows, other columns stay.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import byte_ranges
from .common import append_arrow, slices

# The byte-level split pattern of the public vocabularies, with the Unicode White_Space set spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

_NONE = np.iinfo(np.int32).max
#: Pre-tokens remembered by a worker, pre-tokens handled at once in a long text, symbols merged at once.
REMEMBERED, BLOCK, SYMBOLS = 400_000, 50_000, 1 << 15
#: Characters of short texts handled at once.
GROUP = 1 << 20


def _byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBPE:
    """Counts tokens with the merges of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        special = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError(f"{path} has added tokens that aren't plain strings")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_id = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], dtype=np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.split = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"]))) + ")") if special else None
        self.special = [t["content"] for t in special]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty byte sequence."""
        out = np.array([len(p) for p in pieces], dtype=np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        which = np.repeat(np.arange(len(pieces)), out)
        rank = np.full(len(ids), _NONE, dtype=np.int32)  # of each symbol with the next one of its sequence
        self._rank_at(np.arange(len(ids)), ids, which, rank)
        while len(ids):
            begin = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            lengths = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            going = least < _NONE
            out[which[begin]] = lengths
            if not going.any():
                break
            if not going.all():  # finished sequences leave
                stay = np.repeat(going, lengths)
                ids, which, rank = ids[stay], which[stay], rank[stay]
                least, lengths = least[going], lengths[going]
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # Where one pair overlaps itself (x x x), every second place from the left of its run is merged.
            run = np.append(True, (np.diff(at) != 1) | (np.diff(which[at]) != 0))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, which, rank = ids[keep], which[keep], rank[keep]
            at -= np.arange(len(at))  # one symbol went before each later place
            self._rank_at(np.concatenate([at, at[at > 0] - 1]), ids, which, rank)
        return out

    def _rank_at(self, at: np.ndarray, ids: np.ndarray, which: np.ndarray, rank: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[at < len(ids) - 1]
        at = at[which[at] == which[at + 1]]
        rank[at] = self.ranks(ids[at], ids[at + 1])

    def _learn(self, new: set[str]) -> None:
        pieces, total = [], 0
        words = sorted(new)
        begin = 0
        for i, w in enumerate(words):
            pieces.append(b := w.encode())
            total += len(b)
            if total >= SYMBOLS or i == len(words) - 1:
                self.known.update(zip(words[begin : i + 1], self.merged(pieces).tolist(), strict=True))
                pieces, total, begin = [], 0, i + 1

    def _sums(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens; the unknown ones of all lists are merged together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [list(map(self.known.get, x)) for x in lists]
        short = [i for i, n in enumerate(found) if None in n]
        if short:
            self._learn(set().union(*(lists[i] for i in short)).difference(self.known))
            for i in short:
                found[i] = list(map(self.known.__getitem__, lists[i]))
        return [sum(n) for n in found]

    def _long(self, text: str) -> int:
        n, tokens = 0, (m.group() for m in self.words.finditer(text))
        while block := list(islice(tokens, BLOCK)):
            n += self._sums([block])[0]
        return n

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a group of texts of bounded length is handled at once."""
        out = np.zeros(len(texts), dtype=np.int64)
        owner, parts = [], []
        for i, text in enumerate(texts):
            cut = [text]
            if self.split is not None and any(s in text for s in self.special):
                cut = self.split.split(text)
                out[i] += len(cut) // 2
                cut = cut[::2]
            owner += [i] * len(cut)
            parts += cut
        for lo, hi in slices(np.array([len(p) for p in parts], dtype=np.int64), GROUP):
            if hi == lo + 1 and len(parts[lo]) > GROUP:
                out[owner[lo]] += self._long(parts[lo])
            else:
                np.add.at(out, owner[lo:hi], self._sums([self.words.findall(p) for p in parts[lo:hi]]))
        return out


@lru_cache(maxsize=4)
def _loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``. ``vocabulary`` is a path on every worker or a name that ``public_tokenizers`` knows."""

    def make():
        path = vocabulary
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        bpe = _loaded(path)

        def fn(texts: pa.Array) -> list[pa.Array]:
            _, offsets = byte_ranges(texts)
            n = bpe.count_all([x or "" for x in texts.to_pylist()])
            return [pa.array(np.diff(offsets), pa.int64()), pa.array(n), pa.array(n > limit)]

        return fn

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_arrow(docs, text, fields, make)


