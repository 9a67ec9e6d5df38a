import os

import duckdb
import pytest

from veilcheck.plans.oracle import ORACLE_SQL
from veilcheck.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for f in os.listdir(DATA):
        out.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return out


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)
    assert got
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)
