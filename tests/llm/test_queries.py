"""The corpus queries with SQL give the rows that DuckDB gives."""

import os

import pytest

from gaugeloom.llm import queries
from tests.oracle import check

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(spark, ROOT, queries.QUERIES[name], queries.ORACLE_SQL[name])
