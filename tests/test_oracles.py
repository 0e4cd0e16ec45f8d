"""Every registered query against its DuckDB counterpart."""

import pytest
from compare import DATA, same_rows

from tesselon.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


def test_no_query_lacks_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == set()
