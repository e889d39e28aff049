"""Every query of the subpackage runs; those with SQL agree with DuckDB."""

import pytest

from lodeseam.llm import queries
from tests.test_queries import check, con, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):  # noqa: F811
    check(spark, con, name)
