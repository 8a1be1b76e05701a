"""The queries that SQL can express, against that SQL."""

import pytest
from oracle import connect, same

from kinegrain.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), SQL[name])
