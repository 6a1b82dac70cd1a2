"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.
Keys of at least ``min_chars`` code points that are found in at least ``min_docs`` distinct documents lose
all their lines, except in the document of the largest id that holds them.

Cases: a null or empty text is one empty line; rows of one id are one document; rows whose id is null are
not counted and keep their lines; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Most keys that are broadcast; beyond it the keys are joined by a shuffle.
BROADCAST_KEYS = 200_000
_LINES, _DROP = "__lines", "__drop"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)



def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased alone. lower() serves where no other letter has a lower case; translate() is slower."""
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _row(key: str, text: str) -> Column:
    """Rows of one id may have different texts: a position belongs to an id and a text."""
    return F.xxhash64(F.col(text))


def _keyed(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2): a 128-bit hash of each line long enough to matter."""
    rows = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= min_chars))
    rows = rows.select(F.col(key).alias("id"), _row(key, text).alias("row"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= min_chars).withColumn("line", F.trim("line", F.lit(SPACE)))
    rows = rows.where(F.char_length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return rows.select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line", F.lit(11)).alias("h2"))


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the keys over the threshold. Rows of a task are aggregated before each shuffle."""
    return (
        _keyed(docs, key, text, min_chars)
        .groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, counts: bool = True) -> DataFrame:
    """All rows of ``docs`` with the text without dropped lines; with ``counts``, n_lines and n_dropped replace any such columns."""
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    names = docs.columns
    shared = cut(shared_lines(docs, key, text, min_chars, min_docs), "shared-lines")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    # A dropped line is a position of a document; positions of one document are at most its lines.
    dropped = (
        _keyed(docs, key, text, min_chars)
        .join(shared, ["h1", "h2"])
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "row").agg(F.collect_set("pos").alias(_DROP))
        .select(F.col("id").alias("__id"), F.col("row").alias("__row"), _DROP)
    )
    joined = docs.join(dropped, (F.col(key) == F.col("__id")) & (_row(key, text) == F.col("__row")), "left").drop("__id", "__row")
    rows = joined.withColumn(_LINES, lines_of(F.col(text)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(_LINES) - 1), F.col(_DROP))
    rows = rows.withColumn("__kept", F.when(F.col(_DROP).isNotNull(), kept))
    n_lines = F.size(_LINES).cast("long")
    new_text = F.when(F.col(_DROP).isNull(), F.col(text)).otherwise(F.array_join(F.transform("__kept", lambda i: F.get(F.col(_LINES), i)), "\n"))
    n_dropped = F.when(F.col(_DROP).isNull(), F.lit(0)).otherwise(F.size(_LINES) - F.size("__kept")).cast("long")
    more = [n_lines.alias("n_lines"), n_dropped.alias("n_dropped")] if counts else []
    return rows.select(*(new_text.alias(text) if c == text else F.col(f"`{c}`") for c in names), *more)
