"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from tools.check_oracle import TABLES, rows_of

import __spark_entry__ as E
from vitrine import registry

from .conftest import SF_SMALL

QUERIES = registry.queries()  # the training-data queries have tests of their own
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_is_registered_with_an_oracle_or_a_reason():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = rows_of(cols, cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["category_name", "product_name", "total_sold"]
    assert df.count() >= 0
