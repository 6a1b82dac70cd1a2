"""Vector measures as column expressions over arrays, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import Metric

_ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    """A query vector as one constant."""
    return F.lit([float(x) for x in v]).cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(_ZERO), lambda a, x: a + x)


def dot(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(doubles(u), doubles(v), lambda a, b: a * b))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda a: a * a)))


def l2(u: Column, v: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(u), doubles(v), lambda a, b: (a - b) * (a - b))))


def manhattan(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(doubles(u), doubles(v), lambda a, b: F.abs(a - b)))


def cosine(u: Column, v: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(u) * norm(v)
    return F.when(n == 0, F.lit(_ZERO)).otherwise(dot(u, v) / F.nullif(n, F.lit(_ZERO)))


def cosine_distance(u: Column, v: Column) -> Column:
    return 1 - cosine(u, v)


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda a: a / F.nullif(n, F.lit(_ZERO))))


MEASURES = {Metric.COSINE: cosine, Metric.L2: l2, Metric.DOT: dot, Metric.MANHATTAN: manhattan}


def measure(metric: str | Metric, u: Column, v: Column) -> Column:
    return MEASURES[Metric.of(metric)](u, v)


def similarity(metric: str | Metric, score: Column) -> Column:
    """A score as a similarity: distances d become 1 / (1 + d)."""
    return score if Metric.of(metric).descending else 1 / (1 + score)


def known(score: Column) -> Column:
    """Whether a row has a score: a null or NaN in its vector, a null vector or one of another length give none."""
    return score.isNotNull() & ~F.isnan(score)


def usable(v: Column, dimension: int) -> Column:
    """Whether a vector has the length and no null or NaN."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def ordering(metric: str | Metric, score: str = "score", *ids: str) -> list[Column]:
    """Nearest first, then by id: a total order."""
    first = F.col(score).desc() if Metric.of(metric).descending else F.col(score).asc()
    return [first, *(F.col(i).asc() for i in ids)]


def checked(v: Column, dimension: int) -> Column:
    """The vector, or an error if its length is wrong."""
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, not "), F.size(v).cast("string"))))
