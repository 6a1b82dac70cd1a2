"""Operators over whole tables against plain versions."""

import pytest

from vectrail import queries


def folded(rows):
    ratio = 1e-4
    for _, value in sorted(rows):
        if value is not None and value > 0:
            ratio = 0.2 * (50.0 / value) + 0.8 * ratio
    return ratio


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_latency_ema_folds_all_events(spark, tmp_path, n):
    rows = [(i, [None, 0.0, -2.0, 3.0 + i % 11, 0.5 + i][i % 5]) for i in range(n)]
    rows.reverse()
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["latency_ema"](spark, str(tmp_path)).collect()
    assert [(r["ratio"], r["observations"]) for r in got] == [(pytest.approx(folded(rows), abs=2e-6), n)]


def test_append_takes_all_segments(spark, tmp_path):
    spark.createDataFrame([(i, [1.0], 0) for i in range(750)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["append_union"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["segment_id"]) for r in got) == sorted((i + 1_000_000 * (i // 100 % 2), i // 100) for i in range(750))
