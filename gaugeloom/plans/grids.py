"""Rankings and time grids over the recorded events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions import tristate
from gaugeloom.operators import heatmap
from gaugeloom.plans.registry import REC, SPAN, gauges, query, recorded
from gaugeloom.sources.tables import table

COLUMNS, TOP = 48, 10
WIDTH = SPAN.stop - SPAN.start
INSIDE = f"ts >= {SPAN.start} AND ts < {SPAN.stop}"

GAUGE = f"SELECT user_id, max(cents) AS total FROM rec WHERE {INSIDE} GROUP BY 1"
COUNTER = f"""SELECT user_id, CASE WHEN count(*) >= 2 AND max(ts) > min(ts) AND arg_max(counter, ts) >= arg_min(counter, ts)
  THEN arg_max(counter, ts) - arg_min(counter, ts) END AS total FROM rec WHERE {INSIDE} GROUP BY 1"""


def _ranking(totals: str, whole: str) -> str:
    return f"""
WITH {REC}, t AS ({totals}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, CAST(user_id AS VARCHAR)) AS INTEGER) AS rank FROM t)
SELECT rank, user_id, total, (SELECT CAST({whole}(total) AS BIGINT) FROM t) AS totals_total,
       (SELECT CAST({whole}(total) AS BIGINT) FROM r WHERE rank > {TOP}) AS others_total, (SELECT count(*) FROM t) AS entities
FROM r WHERE rank <= {TOP}"""


@query(_ranking(GAUGE, "max"))
def ranking_gauge_max(spark, root):
    return heatmap.ranking(gauges(spark, root, SPAN), "user_id", "cents", "gauge", SPAN, TOP)


@query(_ranking(COUNTER, "sum"))
def ranking_counter_delta(spark, root):
    return heatmap.ranking(recorded(spark, root), "user_id", "counter", "counter", SPAN, TOP)


@query("""
WITH t AS (SELECT o_custkey AS user_id, max(CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END) AS total FROM orders GROUP BY 1)
SELECT user_id, total FROM t ORDER BY total DESC, CAST(user_id AS VARCHAR) LIMIT 10
""")
def ranking_multi_field(spark, root):
    price, key = F.round(F.col("o_totalprice") * 100).cast("long"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("user_id"), tristate.row_sum(price, key).alias("v"))
    return o.groupBy("user_id").agg(F.max("v").alias("total")).orderBy(F.desc("total"), F.col("user_id").cast("string")).limit(10)


def _cells(value: str) -> str:
    return f"""
o AS (SELECT user_id, event_type, ts, {value} AS v, lag(ts) OVER w AS pts, lag({value}) OVER w AS pv FROM rec WHERE {INSIDE} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
p AS (SELECT *, CAST(least({COLUMNS - 1}, (greatest(coalesce(pts + (ts - pts) // 2, ts), {SPAN.start}) - {SPAN.start}) * {COLUMNS} // {WIDTH}) AS INTEGER) AS col FROM o)"""


RATE_CELLS = f"""{_cells("counter")},
e AS (SELECT user_id, col, min(coalesce(pts, ts)) AS t0, arg_min(coalesce(pv, v), ts) AS v0, max(ts) AS t1, arg_max(v, ts) AS v1 FROM p GROUP BY 1, 2),
c AS (SELECT user_id, col, CASE WHEN t1 > t0 AND v1 >= v0 THEN CAST(v1 - v0 AS DOUBLE) / ((t1 - t0) / 1000000.0::DOUBLE) END AS cell FROM e)"""


@query(f"""
WITH {REC}, t AS ({GAUGE}), {_cells("cents")},
r AS (SELECT user_id, CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, CAST(user_id AS VARCHAR)) AS INTEGER) AS rank FROM t)
SELECT rank, user_id, col, arg_max(v, ts) AS cell FROM p JOIN r USING (user_id) WHERE rank <= {TOP} GROUP BY ALL
""")
def grid_gauge_last(spark, root):
    return heatmap.grid(gauges(spark, root, SPAN), "user_id", "cents", "gauge", SPAN, COLUMNS, TOP)


@query(f"""
WITH {REC}, t AS ({COUNTER}), {RATE_CELLS},
r AS (SELECT user_id, CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, CAST(user_id AS VARCHAR)) AS INTEGER) AS rank FROM t)
SELECT rank, user_id, col, round(cell, 9) AS cell FROM c JOIN r USING (user_id) WHERE rank <= {TOP} AND cell IS NOT NULL
""")
def grid_counter_rate(spark, root):
    return heatmap.grid(recorded(spark, root), "user_id", "counter", "counter", SPAN, COLUMNS, TOP).withColumn("cell", F.round("cell", 9))


@query(f"""
WITH {REC}, t AS ({COUNTER}), {RATE_CELLS},
r AS (SELECT user_id, row_number() OVER (ORDER BY total DESC NULLS LAST, CAST(user_id AS VARCHAR)) AS rank FROM t)
SELECT col, round(sum(cell), 6) AS totals, round(sum(cell) FILTER (rank > {TOP}), 6) AS others, count(cell) AS contributors FROM c JOIN r USING (user_id) GROUP BY col
""")
def grid_totals_others(spark, root):
    found = heatmap.bands(recorded(spark, root), "user_id", "counter", "counter", SPAN, COLUMNS, TOP)
    return found.select("col", F.round("totals", 6).alias("totals"), F.round("others", 6).alias("others"), "contributors")


@query(f"""
WITH {REC}, {_cells("cents")},
l AS (SELECT user_id, col, arg_max(v, ts) AS cell FROM p GROUP BY 1, 2),
g AS (SELECT user_id, arg_min(event_type, ts) AS event_type, max(v) AS total, min(ts) AS first FROM p GROUP BY 1),
s AS (SELECT event_type, CAST(sum(total) AS BIGINT) AS total, count(*) AS members, min(first) AS first FROM g GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, first) AS INTEGER) AS rank FROM s)
SELECT rank, event_type, members, r.total, col, CAST(sum(cell) AS BIGINT) AS cell FROM l JOIN g USING (user_id) JOIN r USING (event_type) WHERE rank <= 3 GROUP BY ALL
""")
def grid_grouped(spark, root):
    return heatmap.grouped_grid(gauges(spark, root, SPAN), "user_id", "event_type", "cents", "gauge", SPAN, COLUMNS, 3)


@query(f"""
WITH {REC}, s AS (SELECT user_id, sum(cents) AS s FROM rec WHERE {INSIDE} GROUP BY 1),
m AS (SELECT user_id, CAST(s AS DOUBLE) / (SELECT count(DISTINCT ts) FROM rec WHERE {INSIDE}) AS mean FROM s)
SELECT user_id, mean, CAST(row_number() OVER (ORDER BY mean DESC, CAST(user_id AS VARCHAR)) AS INTEGER) AS rank FROM m QUALIFY rank <= {TOP}
""")
def grid_shared_mean(spark, root):
    return heatmap.shared_mean(gauges(spark, root, SPAN), "user_id", "cents", SPAN, TOP)


@query(f"WITH {REC} SELECT user_id, arg_max(event_type, ts) AS event_type FROM rec WHERE event_type <> 'click' GROUP BY 1")
def latest_label(spark, root):
    e = gauges(spark, root).withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type")))
    return heatmap.latest_label(e, "user_id", "event_type")


@query(f"""
WITH {REC}, c AS (SELECT user_id, max(cents) AS v FROM rec GROUP BY 1), m AS (SELECT max(v) AS m FROM c)
SELECT user_id, CASE WHEN v <= 0 THEN 0 ELSE CAST(least(6, greatest(1, ceil(6 * sqrt(CAST(v AS DOUBLE) / m)))) AS INTEGER) END AS step FROM c, m
""")
def heatmap_intensity(spark, root):
    c = gauges(spark, root).groupBy("user_id").agg(F.max("cents").alias("v"))
    return c.crossJoin(F.broadcast(c.agg(F.max("v").alias("m")))).select("user_id", heatmap.intensity(F.col("v"), F.col("m")).alias("step"))
