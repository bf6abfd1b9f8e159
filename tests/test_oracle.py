"""Every registered query equals its DuckDB oracle on the sf0.01 tables."""

import pytest

import __spark_entry__ as E
from reelspark.plans import ORACLE, QUERIES
from tools.oracle_check import digest, duck

from .conftest import SF01

NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    got = digest(df.columns, df.collect())
    cur = con.execute(E.oracle_sql()[name])
    want = digest([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], "columns"
    assert got[1] == want[1], "row count"
    assert got[2] == want[2], "values"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["key", "id", "t_ms", "allowed", "tokens", "wait_ms", "retry_after_s"]
