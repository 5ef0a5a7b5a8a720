"""Every core query against its SQL, or at least run."""

import glob
import os

import duckdb
import pytest

from foliospark.plans import queries as core

from .compare import duck_rows, spark_rows

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf):
    cols, rows = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLES:
        want_cols, want = duck_rows(con, ORACLES[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert cols


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
