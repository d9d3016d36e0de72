"""Snapshots, finders, row details, as-of joins and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions import counters, search
from gaugeloom.functions.timeutil import ts_us
from gaugeloom.operators import snapshot
from gaugeloom.plans.registry import AT, DAY, REC, gauges, query, recorded
from gaugeloom.sources.tables import table

#: Lineitems as snapshots: a moment per ship month, entities by supplier and part size class, quantities as a counter.
MOMENTS = """m AS (
  SELECT epoch_us(date_trunc('month', l_shipdate)) AS ts, l_suppkey AS pid, CAST(l_partkey % 7 AS INTEGER) AS slot, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls, count(*) AS n
  FROM lineitem GROUP BY ALL)"""
MONTH = 31 * DAY
SHIP_AT = 915_148_800_000_000  # 1999-01-01


def moments(spark, root):
    li = table(spark, root, "lineitem")
    ts = ts_us(F.date_trunc("month", F.col("l_shipdate")))
    return li.groupBy(ts.alias("ts"), F.col("l_suppkey").alias("pid"), (F.col("l_partkey") % 7).cast("int").alias("slot")).agg(F.sum(F.col("l_quantity").cast("long")).alias("calls"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {MOMENTS} SELECT * FROM m WHERE ts = (SELECT max(ts) FROM m WHERE ts <= {SHIP_AT})")
def snapshot_at(spark, root):
    return snapshot.at_moment(moments(spark, root), SHIP_AT)


RATE = "CASE WHEN c.ts > p.ts AND c.calls >= p.calls THEN CAST(c.calls - p.calls AS DOUBLE) / ((c.ts - p.ts) / 1000000.0::DOUBLE) END"


@query(f"""
WITH {MOMENTS}, a AS (SELECT max(ts) AS ts FROM m WHERE ts <= {SHIP_AT}), b AS (SELECT max(ts) AS ts FROM m WHERE ts < (SELECT ts FROM a))
SELECT c.ts, c.pid, c.slot, c.n, {RATE} AS calls FROM m c LEFT JOIN (SELECT * FROM m WHERE ts = (SELECT ts FROM b)) p ON c.pid = p.pid AND c.slot = p.slot
WHERE c.ts = (SELECT ts FROM a)
""")
def snapshot_rates(spark, root):
    return snapshot.with_rates(moments(spark, root), SHIP_AT, ["pid", "slot"], ["calls"])


PARTITIONED = f"""
t AS (SELECT DISTINCT pid, ts FROM m WHERE ts <= {SHIP_AT}),
k AS (SELECT pid, ts, row_number() OVER (PARTITION BY pid ORDER BY ts DESC) AS r FROM t),
w AS (SELECT pid, max(ts) FILTER (r = 1) AS now, max(ts) FILTER (r = 2) AS past FROM k GROUP BY 1),
s AS (SELECT c.ts, c.pid, c.slot, c.n, {RATE} AS calls FROM m c JOIN w ON c.pid = w.pid AND c.ts = w.now LEFT JOIN m p ON p.pid = c.pid AND p.slot = c.slot AND p.ts = w.past)"""


@query(f"WITH {MOMENTS}, {PARTITIONED} SELECT * FROM s")
def snapshot_partitioned(spark, root):
    return snapshot.partitioned(moments(spark, root), SHIP_AT, "pid", ["slot"], ["calls"])


@query(f"WITH {MOMENTS}, {PARTITIONED} SELECT * FROM s WHERE ts >= {SHIP_AT} - {MONTH}")
def finder_lookback(spark, root):
    return snapshot.partitioned(moments(spark, root), SHIP_AT, "pid", ["slot"], ["calls"], look_back=MONTH)


@query(f"""
WITH {MOMENTS}, a AS (SELECT * FROM m WHERE ts = (SELECT max(ts) FROM m WHERE ts <= {SHIP_AT}))
SELECT *, (SELECT count(*) FROM a) AS eligible, (SELECT count(*) > 20 FROM a) AS truncated FROM a ORDER BY calls DESC NULLS LAST, pid, slot LIMIT 20
""")
def snapshot_page(spark, root):
    return snapshot.page(snapshot.at_moment(moments(spark, root), SHIP_AT), "calls", ["pid", "slot"], 20)


@query(f"""
WITH {REC}, d AS (
  SELECT event_id, user_id, ts, lag(ts) OVER w AS previous_ts, counter, lag(counter) OVER w AS before FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id, ts, previous_ts, CASE WHEN counter >= before AND ts > previous_ts THEN CAST(counter - before AS DOUBLE) / ((ts - previous_ts) / 1000000.0::DOUBLE) END AS counter_rate
FROM d
""")
def row_detail_predecessor(spark, root):
    got = snapshot.row_detail(recorded(spark, root), ["user_id"], ["counter"])
    return got.select("event_id", "user_id", "ts", "previous_ts", "counter_rate")


@query(f"""
WITH {REC}, d AS (
  SELECT event_id, user_id, ts, lag(ts) OVER w AS previous_ts, counter, lag(counter) OVER w AS before FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id, ts, previous_ts, CASE WHEN counter >= before AND ts > previous_ts THEN CAST(counter - before AS DOUBLE) / ((ts - previous_ts) / 1000000.0::DOUBLE) END AS counter_rate
FROM d WHERE event_id = 777
""")
def row_detail_one(spark, root):
    return snapshot.detail_of_one(recorded(spark, root), ["user_id"], ["counter"], F.col("event_id") == 777).select("event_id", "user_id", "ts", "previous_ts", "counter_rate")


@query(f"WITH {MOMENTS}, a AS (SELECT * FROM m WHERE ts = (SELECT max(ts) FROM m WHERE ts <= {SHIP_AT})) SELECT * FROM a ORDER BY calls DESC NULLS LAST, pid, slot LIMIT 20 OFFSET 20")
def snapshot_page_after(spark, root):
    rows = snapshot.at_moment(moments(spark, root), SHIP_AT)
    last = snapshot.page(rows, "calls", ["pid", "slot"], 20, eligible=False).tail(1)[0]  # of 20 rows
    return snapshot.page(rows.where(snapshot.after("calls", ["pid", "slot"], snapshot.cursor_of(last, "calls", ["pid", "slot"]))), "calls", ["pid", "slot"], 20, eligible=False)


@query(f"WITH {MOMENTS}, a AS (SELECT * FROM m WHERE ts = (SELECT max(ts) FROM m WHERE ts <= {SHIP_AT})) SELECT count(*) AS eligible, least(count(*), 20) AS returned, count(*) > 20 AS truncated, min(ts) AS sample_from, max(ts) AS sample_to FROM a")
def snapshot_page_facts(spark, root):
    return snapshot.page_facts(snapshot.at_moment(moments(spark, root), SHIP_AT), 20)


@query(f"WITH {REC} SELECT event_id, user_id, ts FROM rec WHERE user_id = 11 AND ts <= {AT} ORDER BY ts DESC LIMIT 1")
def first_match(spark, root):
    return snapshot.first_match(recorded(spark, root), (F.col("user_id") == 11) & (F.col("ts") <= AT), "ts").select("event_id", "user_id", "ts")


@query(f"""
WITH {REC}, l AS (SELECT event_id, user_id, ts FROM rec WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS asof_ts, cents FROM rec WHERE event_type = 'view')
SELECT l.event_id, l.user_id, l.ts, CASE WHEN l.ts - asof_ts <= {2 * DAY} THEN asof_ts END AS asof_ts, CASE WHEN l.ts - asof_ts <= {2 * DAY} THEN cents END AS cents
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.asof_ts
""")
def asof_tolerance(spark, root):
    e = gauges(spark, root)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", "cents")
    return counters.asof(left, right, ["user_id"], ["cents"], tolerance=2 * DAY)


@query(f"""
WITH {REC}, l AS (SELECT user_id, ts FROM rec WHERE event_type = 'error'), r AS (SELECT user_id, ts FROM rec WHERE event_type = 'signup')
SELECT count(*) AS preceded FROM l SEMI JOIN (SELECT user_id, min(ts) AS first FROM r GROUP BY 1) f ON l.user_id = f.user_id AND f.first <= l.ts
""")
def asof_semi_count(spark, root):
    e = gauges(spark, root)
    errors = counters.preceded(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), ["user_id"])
    return errors.agg(F.count(F.lit(1)).alias("preceded"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT starts_with(o_orderpriority, '1-')
  AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'MACHINERY' AND c_custkey <> 0)
""")
def anti_scope(spark, root):
    left_out = table(spark, root, "customer").where("c_mktsegment = 'MACHINERY' AND c_custkey <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, root, "orders").where(~F.col("o_orderpriority").startswith("1-")).join(left_out, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%r_d%g%'")
def search_glob(spark, root):
    return table(spark, root, "part").where(search.glob(F.col("p_name"), "R?d*G")).select("p_partkey", "p_name")


@query("""
SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM orders GROUP BY 1
HAVING sum(CAST(round(o_totalprice * 100) AS BIGINT)) > 20000000.5 * count(*)
""")
def search_quantity(spark, root):
    sums = table(spark, root, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    return sums.where(search.above(F.col("cents"), "20000000.5", F.col("n")))


@query("""
SELECT c_mktsegment, count(*) AS members, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer
WHERE (lower(c_name) LIKE '%7' OR CAST(c_nationkey AS VARCHAR) = '3') AND lower(c_mktsegment) <> 'machinery' GROUP BY 1 HAVING sum(c_nationkey) > 9
""")
def search_bool_tree(spark, root):
    member = (F.lower("c_name").endswith("7") | search.identifier(F.col("c_nationkey"), "3")) & ~search.exact(F.col("c_mktsegment"), "machinery")
    groups = table(spark, root, "customer").where(member).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("members"), F.sum("c_nationkey").alias("total"))
    return groups.where(search.above(F.col("total"), "9"))
