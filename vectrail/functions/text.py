"""Text functions: hashes, tokens, sentences, keyword overlap, JSON equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def derived_id(*parts: Column) -> Column:
    """A stable id from its parts, the same whenever the plan is computed again."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def query_words(query: str) -> list[str]:
    """Lower-cased words of three characters or more, repeats included."""
    return [w for w in query.lower().split() if len(w) > 2]


def keyword_score(text: Column, words: list[str]) -> Column:
    """Share of the query's words that the lower-cased text contains; 0 without words."""
    if not words:
        return F.lit(0.0)
    low = F.lower(text)
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return F.coalesce(hits, F.lit(0)) / F.lit(float(len(words)))


def sentences(text: Column) -> Column:
    """Split after . ? ! and white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+"), lambda s: F.trim(s, F.lit(" \t\n\r\x0b\f"))), lambda s: s != "")


def clean_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]", "")


def canonical_json(value: Column) -> Column:
    """JSON text with sorted keys and plain numbers, so that equal values are equal texts."""
    return F.to_json(F.parse_json(value))


def json_equal(value: Column, literal: str) -> Column:
    return canonical_json(value) == canonical_json(F.lit(literal))
