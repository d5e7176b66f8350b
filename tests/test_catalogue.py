"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from larkspur.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def shown(frame):
    def cell(x):
        if x is None or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and math.isfinite(x) and x == int(x) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert shown(got) == shown(duck.sql(SQL[name]).df())
    else:
        assert len(got.columns)
