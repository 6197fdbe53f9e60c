"""Every query with SQL gives the SQL's rows on the smallest tables."""

import pytest
from compare import differs, duck

from scrivano.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert differs(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
