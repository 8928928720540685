"""Registered training-data queries that SQL can express give its rows."""

import oracle
import pytest
from conftest import SF

from siftmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(spark, oracle.connection(SF), queries.QUERIES[name], queries.ORACLE[name], SF) is None
