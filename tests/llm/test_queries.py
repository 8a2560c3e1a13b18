from __future__ import annotations

import pytest

from oracle_check import compare, oracle_connection
from tidecast.llm.oracle import all_sql
from tidecast.llm.queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_sql(spark, name):
    problems, rows = compare(spark, oracle_connection(SF), name, all_queries()[name], all_sql()[name], SF)
    assert problems == [] and rows > 0


def test_a_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in all_queries()) == list(range(1, 14))
