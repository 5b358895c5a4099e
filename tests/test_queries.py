"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1e-4)
    return a == b


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = ordered(tuple(r[c] for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = ordered(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 7
