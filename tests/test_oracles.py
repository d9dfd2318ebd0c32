"""Every core query with SQL against DuckDB on the same tables."""

import pytest

from quillmark import registry

QUERIES, SQL = registry.collect(registry.MODULES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, duck, sf, same):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())

