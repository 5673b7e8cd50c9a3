"""Every query with SQL gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from pawl.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in found.collect())
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
