"""Every query with SQL gives the rows that DuckDB gives; entry() runs."""

import os

import pytest

from gaugeloom.plans import registry
from tests.oracle import check

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(spark, ROOT, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_range_of_time_reaches_the_scan(spark):
    """The conditions on columns that the table has are pushed to Parquet, and only columns in use are read."""
    from gaugeloom.operators.rows import typed_equals
    from gaugeloom.sources.tables import table

    found = typed_equals(table(spark, ROOT, "events"), {"event_type": "error"}).select("event_id")
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(event_type,error)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
