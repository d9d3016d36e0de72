"""Queries over rows of sections: catalog, pages, history, filters, unions, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions.timeutil import HOUR, hour_of, ts_us
from gaugeloom.operators import rows
from gaugeloom.plans.registry import AT, EPOCH, REC, SPAN, query
from gaugeloom.sources.tables import table


@query("""
SELECT 'events' AS name, count(*) AS rows, 6 AS fields, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts FROM events
UNION ALL SELECT 'orders', count(*), 6, min(epoch_us(o_orderdate)), max(epoch_us(o_orderdate)) FROM orders
UNION ALL SELECT 'customer', count(*), 5, NULL, NULL FROM customer
""")
def catalog_sections(spark, root):
    timed = lambda name, ts: table(spark, root, name).withColumn(ts, ts_us(ts))
    return rows.catalog({"events": (timed("events", "ts"), "ts"), "orders": (timed("orders", "o_orderdate"), "o_orderdate"), "customer": (table(spark, root, "customer"), None)})


@query("""
SELECT event_id, user_id, event_type, (SELECT count(*) > 200 FROM events WHERE event_id > 300) AS has_more
FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 200
""")
def rows_page_asc(spark, root):
    return rows.page(table(spark, root, "events").select("event_id", "user_id", "event_type"), "event_id", 200, after=300)


@query("""
SELECT event_id, user_id, event_type, (SELECT count(*) > 200 FROM events WHERE event_id < 700) AS has_more
FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 200
""")
def rows_page_desc(spark, root):
    return rows.page(table(spark, root, "events").select("event_id", "user_id", "event_type"), "event_id", 200, after=700, descending=True)


@query(f"""
WITH {REC} SELECT ts, cents, CAST(NULL AS VARCHAR) AS wait_event, user_id FROM rec WHERE ts >= {SPAN.start} AND ts < {SPAN.stop}
""")
def history_projection(spark, root):
    section = table(spark, root, "events").select(ts_us("ts").alias("ts"), "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.project(section.where(SPAN.holds()), ["ts", "cents", "wait_event", "user_id"])


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id = 7")
def typed_filter(spark, root):
    return rows.typed_equals(table(spark, root, "events"), {"event_type": "error", "user_id": 7}).select("event_id", "user_id", "value")


@query("""
SELECT 1 AS type_id, event_id, user_id, value, CAST(NULL AS VARCHAR) AS event_type, false AS has_event_type FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 2, event_id, user_id, value, event_type, true FROM events WHERE event_id % 2 = 1
""")
def layout_union(spark, root):
    e = table(spark, root, "events").select("event_id", "user_id", "value", "event_type")
    return rows.union_layouts({1: e.where("event_id % 2 = 0").drop("event_type"), 2: e.where("event_id % 2 = 1")})


@query("SELECT 2 AS type_id, event_id, user_id, value, event_type FROM events WHERE event_id % 2 = 1 AND event_type = 'view'")
def layout_filter_absent(spark, root):
    e = table(spark, root, "events").select("event_id", "user_id", "value", "event_type")
    wanted = {"event_type": "view"}
    layouts = {1: rows.typed_equals(e.where("event_id % 2 = 0").drop("event_type"), wanted), 2: rows.typed_equals(e.where("event_id % 2 = 1"), wanted)}
    return rows.union_layouts(layouts).drop("has_event_type")


@query(f"""
WITH {REC}, b AS (SELECT max(ts) FILTER (ts < {AT}) AS low, min(ts) FILTER (ts > {AT + HOUR}) AS high FROM rec WHERE ts BETWEEN {AT - 30 * HOUR} AND {AT + 31 * HOUR})
SELECT event_id, ts, user_id FROM rec, b WHERE ts BETWEEN {AT - 30 * HOUR} AND {AT + 31 * HOUR} AND (ts BETWEEN {AT} AND {AT + HOUR} OR ts = low OR ts = high)
""")
def slice_cohorts(spark, root):
    section = table(spark, root, "events").select("event_id", ts_us("ts").alias("ts"), "user_id")
    return rows.slice_rows(section, AT, AT + HOUR, "snapshot_full", context=30 * HOUR)


@query(f"""
WITH {REC} SELECT event_id, ts, user_id FROM rec WHERE ts BETWEEN {AT - 2 * HOUR} AND {AT + 3 * HOUR}
""")
def slice_changes(spark, root):
    section = table(spark, root, "events").select("event_id", ts_us("ts").alias("ts"), "user_id")
    return rows.slice_rows(section, AT, AT + HOUR, "on_change", context=2 * HOUR)


@query(f"""
SELECT DISTINCT (epoch_us(ts) - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS hour FROM events
""")
def recorded_hours(spark, root):
    return table(spark, root, "events").select(hour_of(ts_us("ts")).alias("hour")).distinct()


@query("SELECT bool_or(n > 0) AS any, bool_or(n > 0) AS metrics FROM (SELECT count(*) AS n FROM events)")
def source_presence(spark, root):
    return rows.presence(rows.catalog({"events": (table(spark, root, "events"), None)}))
