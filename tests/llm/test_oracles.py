"""Every query of the subpackage that SQL can express, against that SQL."""

import pytest

from factloom.llm import queries
from tests.session import SF, same_as_sql


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
