"""Every registered query against its SQL in DuckDB."""

import pytest

from tallyfield.plans import registered, registered_sql
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_same_as_sql(spark, con, name):
    result = registered.QUERIES[name](spark, SF)
    assert difference(result, con, registered_sql.SQL[name]) is None
