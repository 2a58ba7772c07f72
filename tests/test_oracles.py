"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(queries()) & set(oracle_sql())))
def test_query_matches_sql(spark, con, name):
    difference, rows, _ = compare(spark, con, queries()[name], oracle_sql()[name], SF_DIR)
    assert difference is None
    assert rows > 0


def test_sql_is_of_queries_and_covers_all_of_this_library_s_own():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 200
