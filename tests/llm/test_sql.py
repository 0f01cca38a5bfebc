"""Registered text queries beside their SQL."""

import pytest
from oracle import compared

from railframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    assert compared(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
