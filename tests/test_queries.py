"""Every registered query but those of the subpackage llm: against its SQL."""

import pytest
from compare import same

from tabloom import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf), duck, SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
