"""The driver contract: names agree and every SQL twin belongs to a query."""

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100
