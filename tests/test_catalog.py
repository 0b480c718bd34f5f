"""Every registered query against its SQL on the smallest data, by value."""

import math
import os

import pytest

from ledgerloom.catalog import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return round(float(x), 5) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    query = QUERIES[name]
    got = query.run(spark, DATA)
    want = oracle.sql(query.sql)
    assert sorted(got.columns) == sorted(want.columns)
    have = rows_of(got.columns, got.collect())
    assert have and have == rows_of(want.columns, want.fetchall())
