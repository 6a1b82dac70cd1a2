"""Each core query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from vectrail import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.ORACLE_SQL:
        r = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, r.fetchall())
    else:
        assert got


def test_recall(spark):
    found = [r["recall"] for r in queries.QUERIES["hnsw_recall"](spark, DIR).collect()]
    assert sum(found) / len(found) >= 0.9
