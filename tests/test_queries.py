"""Every query of the core library against its SQL, or at least to its end."""

import pytest

from oracle import DATA, assert_same, connect
from quern.plans import catalog


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    sql = catalog.sql().get(name)
    if sql:
        assert_same(con, df, sql)
    else:
        assert df.count() > 0


def test_every_sql_has_its_query():
    assert set(catalog.sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
