"""Every registered query with SQL gives what DuckDB gives for that SQL."""

import pytest

from casebook.plans import registry
from tests.oracle import duck, rows

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck(sf_dir).execute(sql).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)
