"""Every query with SQL gives the SQL's rows; the others run and have rows."""

import pytest

from vellumine.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
