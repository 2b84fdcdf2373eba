"""Every registered query against its SQL."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from workload import tables
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in QUERIES]  # those of the text operators are in tests/llm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture(scope="module", autouse=True)
def one_panel():
    """The panel is built once for all queries."""
    tables.kept = {}
    yield
    tables.kept = None


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.difference(df, con, sql) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
