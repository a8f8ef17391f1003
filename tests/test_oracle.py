"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

from remnant.plans import registry

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sql = registry.oracle_sql().get(name)
    status, rows, _, detail = compare(spark, con, name, registry.queries()[name], sql, PATH)
    assert status == ("rows" if sql is None else "ok"), detail


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["run", "cka", "diagnosis"]
    assert set(e.oracle_sql()) <= set(e.queries())
