"""Queries of this subpackage that SQL can express, against it."""

import pytest
from compare import DATA, same_rows

from tesselon.llm.entries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


def test_all_are_there():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
