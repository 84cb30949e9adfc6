"""Every registered query that has reference SQL against it, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_reference_sql(spark, connection, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, connection.execute(entry.oracle_sql()[name]).df()) is None


def test_which_queries_have_no_sql():
    assert set(entry.QUERIES) - set(entry.oracle_sql()) == {
        "nightly_snapshot"}
