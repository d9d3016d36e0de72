"""Names of the queries, their Spark plans and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeloom.functions.timeutil import TimeRange, ts_us
from gaugeloom.sources.tables import table

FLAGSHIP = "grid_counter_rate"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86_400_000_000
EPOCH = 1_704_067_200_000_000  # 2024-01-01
SPAN = TimeRange(EPOCH + 4 * DAY, EPOCH + 24 * DAY)
AT = EPOCH + 20 * DAY
MODULUS = 100_000

#: The events as a recorded section, in SQL: a gauge in cents and a counter that starts anew at MODULUS.
REC = f"""rec AS (
  SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) % {MODULUS} AS BIGINT) AS counter
  FROM events)"""


def query(sql: str | None = None):
    """Registers a query by its name, and its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def gauges(spark: SparkSession, root: str, span: TimeRange | None = None) -> DataFrame:
    """The events as a recorded section without the counter; a range of time is left to the scan."""
    rows = table(spark, root, "events")
    rows = rows if span is None else rows.where(span.holds_raw("ts"))
    return rows.select("event_id", ts_us("ts").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """The events as a recorded section: ts in microseconds, identity user_id, gauge cents, counter."""
    return gauges(spark, root).withColumn("counter", F.sum("cents").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) % MODULUS)


from gaugeloom.plans import finders, grids, logs, processes, relations, sections, sequences, snapshots, structures  # noqa: E402, F401
