"""Metadata filters: key/value rows, conjunctions, selectivity."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_equal

MINIMUM = 0.001


def unpivot(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value): each column's value as JSON text; nulls are absent."""
    pairs = [F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNotNull(), _json(rows, c)).alias("value")) for c in columns]
    return rows.select(key, F.explode(F.array(*pairs)).alias("kv")).select(key, "kv.key", "kv.value").where(F.col("value").isNotNull())


def _json(rows: DataFrame, column: str) -> Column:
    if dict(rows.dtypes)[column] == "string":
        return F.regexp_replace(F.to_json(F.struct(F.col(column).alias("v"))), r'^\{"v":(.*)\}$', "$1")
    return F.col(column).cast("string")


def matches(filters: dict[str, Any]) -> Column:
    """Whether a key/value row satisfies one of the filters."""
    out = F.lit(False)
    for k, v in filters.items():
        out = out | ((F.col("key") == k) & json_equal(F.col("value"), json.dumps(v, ensure_ascii=False)))
    return out


def resolve(metadata: DataFrame, filters: dict[str, Any], key: str) -> DataFrame:
    """Keys whose metadata satisfies all filters; no filters select nothing. One aggregation, partial in each task."""
    rows = metadata.where(matches(filters) if filters else F.lit(False))
    return rows.groupBy(key).agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(filters)).select(key)


def selectivity(metadata: DataFrame, filters: dict[str, Any], all_keys: DataFrame, key: str) -> DataFrame:
    """One row ``selectivity``: share of the keys that pass, at least 0.001; 1 without filters or keys."""
    total = all_keys.select(key).distinct().agg(F.count("*").alias("total"))
    if not filters:
        return total.select(F.lit(1.0).alias("selectivity"))
    found = resolve(metadata, filters, key).join(all_keys.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("matched"))
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.greatest(F.lit(MINIMUM), F.col("matched") / F.greatest("total", F.lit(1))))
    return found.crossJoin(total).select(share.alias("selectivity"))  # one row each
