"""Every registered query against its DuckDB counterpart on the smallest tables."""

import pytest

from mietwerk.plans import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, same):
    found = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLES:
        same(found, duck.execute(registry.ORACLES[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == registry.QUERIES[registry.FLAGSHIP](spark, SMALL).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
