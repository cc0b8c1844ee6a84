"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from corpusloom import catalog
from tests.oracle import connect, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = rows_of_spark(QUERIES[name](spark, SF))
    expected_names, expected = rows_of_duck(con, SQL[name])
    assert names == expected_names
    assert rows == expected
