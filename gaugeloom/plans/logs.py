"""Event groups and log-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions import logs
from gaugeloom.functions.timeutil import HOUR
from gaugeloom.operators import events
from gaugeloom.plans.registry import AT, DAY, EPOCH, REC, gauges, query, recorded
from gaugeloom.sources.tables import table

START = EPOCH + 10 * DAY


def _strip(key: str) -> str:
    return f"(SELECT map_from_entries(list((m, n) ORDER BY m)) FROM (SELECT (ts - {START}) // 60000000 AS m, sum(w) AS n FROM x WHERE x.{key} = g.{key} AND (ts - {START}) // 60000000 BETWEEN 0 AND 59 GROUP BY 1))"


GROUPED = "x AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS w FROM rec)"


def _weighted(spark, root):
    return gauges(spark, root).withColumn("count", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4))


@query(f"""
WITH {REC}, {GROUPED}
SELECT event_type, user_id, CAST(sum(w) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_id, ts) AS representative FROM x GROUP BY 1, 2
""")
def event_groups_errors(spark, root):
    return events.groups(_weighted(spark, root), ["event_type", "user_id"], F.col("count"), START).drop("by_minute")


@query(f"""
WITH {REC}, {GROUPED}
SELECT user_id, CAST(sum(w) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(event_id, (cents, -ts)) AS representative FROM x GROUP BY 1
""")
def event_groups_slow(spark, root):
    return events.groups(_weighted(spark, root), ["user_id"], F.col("count"), START, score=F.col("cents")).drop("by_minute")


@query(f"""
WITH {REC}, {GROUPED} SELECT event_type, CAST((ts - {START}) // 60000000 AS INTEGER) AS minute, CAST(sum(w) AS BIGINT) AS n FROM x WHERE ts >= {START} AND ts < {START + HOUR} GROUP BY 1, 2
""")
def event_minutes(spark, root):
    found = events.groups(_weighted(spark, root), ["event_type"], F.col("count"), START)
    return found.select("event_type", F.explode("by_minute").alias("minute", "n"))


@query(f"""
WITH {REC}, x AS (SELECT event_id, ts, event_type, CAST(list_position(['view', 'error'], event_type) - 1 AS INTEGER) AS source_rank FROM rec WHERE ts BETWEEN {START} AND {START + HOUR} AND event_type IN ('view', 'error'))
SELECT *, (SELECT count(*) > 5 FROM x) AS truncated FROM x ORDER BY ts, source_rank, event_id LIMIT 5
""")
def event_occurrences(spark, root):
    e = recorded(spark, root).drop("counter", "user_id", "cents")
    return events.occurrences(e, START, START + HOUR, ["view", "error"], 5, source="event_type")


@query(f"""
WITH {REC}, w AS (SELECT user_id, ts, event_id AS holders FROM rec WHERE event_type = 'view'), a AS (SELECT event_id, user_id, ts FROM rec WHERE event_type = 'purchase')
SELECT a.event_id, a.user_id, a.ts, holders FROM a ASOF LEFT JOIN w ON a.user_id = w.user_id AND a.ts >= w.ts
""")
def lock_acquired_match(spark, root):
    e = gauges(spark, root).withColumn("holders", F.col("event_id"))
    return events.lock_matches(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "holders")


@query(f"""
WITH {REC} SELECT user_id, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS shared, count(*) AS n FROM rec WHERE ts >= {AT} GROUP BY 1
""")
def shared_text(spark, root):
    return recorded(spark, root).where(F.col("ts") >= AT).groupBy("user_id").agg(events.shared_text("event_type").alias("shared"), F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT o_orderkey % 3 AS phase, CASE WHEN o_orderkey % 2 = 0 THEN 'time' ELSE 'wal' END AS reason, o_orderkey AS sync FROM orders)
SELECT greatest(count(*) FILTER (phase = 0), count(*) FILTER (phase = 1)) AS n, count(*) FILTER (phase = 0 AND reason = 'time') AS timed,
       count(*) FILTER (phase = 0) - count(*) FILTER (phase = 0 AND reason = 'time') AS requested, max(sync) AS max_sync, CAST(sum(sync) AS BIGINT) AS buffers FROM x
""")
def event_checkpoints(spark, root):
    o = table(spark, root, "orders").select((F.col("o_orderkey") % 3).alias("phase"), F.when(F.col("o_orderkey") % 2 == 0, "time").otherwise("wal").alias("reason"), F.col("o_orderkey").alias("sync"))
    return events.checkpoints(o, "phase", "reason", "sync", "sync")


@query("""
SELECT o_orderstatus AS kind, o_custkey AS relation, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS elapsed, CAST(sum(o_orderkey * 2) AS BIGINT) AS removed,
       arg_max_null(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_orderkey) AS dead, min(o_orderkey) AS first_ts, max(o_orderkey) AS last_ts FROM orders GROUP BY 1, 2
""")
def event_autovacuum(spark, root):
    k = F.col("o_orderkey")
    o = table(spark, root, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("relation"), k.alias("ts"), k.alias("e"), (k * 2).alias("r"), F.when(k % 3 != 0, k).alias("dead"))
    return events.autovacuum(o, "kind", "relation", "e", "r", "dead")


@query("""
WITH t AS (SELECT s_nationkey AS holders, s_suppkey % 4 AS target, min(s_suppkey) AS t FROM supplier GROUP BY 1, 2), g AS (SELECT holders, list(target ORDER BY t) AS targets FROM t GROUP BY 1)
SELECT s_nationkey AS holders, count(*) AS n, count(DISTINCT s_suppkey) AS waiters, max(s_suppkey) AS longest, array_to_string(any_value(targets), ',') AS targets FROM supplier JOIN g ON holders = s_nationkey GROUP BY 1
""")
def event_lock_waits(spark, root):
    k = F.col("s_suppkey")
    s = table(spark, root, "supplier").select(F.col("s_nationkey").alias("holders"), k.alias("pid"), (k % 4).alias("target"), k.alias("d"), k.alias("ts"))
    return events.waits(s, "holders", "pid", "target", "d").withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


@query("SELECT count(*) AS n, min(o_orderkey) AS least_seconds, 'notable' AS tier FROM orders WHERE o_orderkey % 3 = 2 HAVING count(*) > 0")
def event_checkpoint_warnings(spark, root):
    return events.checkpoint_warnings(table(spark, root, "orders").withColumn("phase", F.col("o_orderkey") % 3), "phase", "o_orderkey")


@query("SELECT o_orderkey, o_custkey % 4 AS kind, CAST(1 AS BIGINT) AS n, CASE WHEN o_custkey % 4 = 0 THEN 'critical' ELSE 'notable' END AS tier FROM orders")
def event_lifecycle(spark, root):
    return events.lifecycle(table(spark, root, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("kind")), "kind")


@query("""
SELECT o_custkey % 4 AS level, o_orderpriority AS text, count(*) AS n, min(o_orderkey) AS first_ts, max(o_orderkey) AS last_ts, min(o_orderkey) AS representative,
       CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status, CASE o_custkey % 4 WHEN 0 THEN 'critical' WHEN 3 THEN 'routine' ELSE 'notable' END AS tier
FROM orders GROUP BY 1, 2
""")
def event_pooler_groups(spark, root):
    o = table(spark, root, "orders").select((F.col("o_custkey") % 4).alias("level"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("ts"), F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))
    return events.pooler_groups(o, "level", "text", ["status"])


@query("""
WITH f AS (SELECT o_orderstatus AS target, min(o_orderkey) AS k, count(*) AS n FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders w WHERE w.o_orderpriority = '1-URGENT' AND w.o_custkey = a.o_custkey AND w.o_orderkey <= a.o_orderkey) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, min(k) AS representative, string_agg(target, ',' ORDER BY k) AS targets FROM f
""")
def event_locks_unmatched(spark, root):
    o = table(spark, root, "orders").select("o_custkey", F.col("o_orderkey").alias("ts"), F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("target"), "o_orderpriority")
    waiting = o.where("o_orderpriority = '1-URGENT'").withColumn("holders", F.col("ts").cast("string"))
    matched = events.lock_matches(waiting, o, ["o_custkey"], "holders").join(o.select("event_id", "target"), "event_id")
    return events.unmatched(matched, "target").withColumn("targets", F.array_join("targets", ","))


@query("SELECT (CASE WHEN o_custkey % 3 > 0 THEN o_custkey * CASE o_orderstatus WHEN 'F' THEN 1000 WHEN 'O' THEN 60000 ELSE 1 END END)::DOUBLE AS threshold_ms FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def event_slow_threshold(spark, root):
    unit = F.when(F.col("o_orderstatus") == "F", "s").when(F.col("o_orderstatus") == "O", "min").otherwise("ms")
    o = table(spark, root, "orders").select(F.lit("log_min_duration_statement").alias("name"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).otherwise(-1).alias("value"), unit.alias("unit"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"))
    return events.slow_threshold(o, "name", "value", "unit")


#: Messages made of order columns; `m` in SQL and messages() in Spark are the same texts.
MESSAGES = """m AS (
  SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN 'duplicate key value violates unique constraint "' || o_orderpriority || '" at character ' || o_orderkey
    WHEN 1 THEN 'process ' || o_orderkey || ' still waiting for ShareLock on transaction ' || o_custkey || ' after ' || o_orderkey || '.5 ms'
    WHEN 2 THEN 'relation "" of ''' || o_orderstatus || ''' does not exist (' || o_custkey || ')'
    WHEN 3 THEN 'server process (PID ' || o_orderkey || ') was terminated by signal 9: Killed'
    WHEN 4 THEN 'invalid input syntax for type integer: "' || o_orderkey || '"'
    ELSE 'permission denied for table t' || o_custkey END AS message,
    CASE o_orderkey % 7 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'PANIC' ELSE 'ERROR' END AS severity FROM orders)"""


def messages(spark, root):
    return table(spark, root, "orders").select(
        "o_orderkey",
        F.expr("""CASE o_orderkey % 6
    WHEN 0 THEN 'duplicate key value violates unique constraint "' || o_orderpriority || '" at character ' || o_orderkey
    WHEN 1 THEN 'process ' || o_orderkey || ' still waiting for ShareLock on transaction ' || o_custkey || ' after ' || o_orderkey || '.5 ms'
    WHEN 2 THEN 'relation "" of \\'' || o_orderstatus || '\\' does not exist (' || o_custkey || ')'
    WHEN 3 THEN 'server process (PID ' || o_orderkey || ') was terminated by signal 9: Killed'
    WHEN 4 THEN 'invalid input syntax for type integer: "' || o_orderkey || '"'
    ELSE 'permission denied for table t' || o_custkey END""").alias("message"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'PANIC' ELSE 'ERROR' END").alias("severity"),
    )


PATTERNS = """p AS (
  SELECT o_orderkey, severity, CASE o_orderkey % 6
    WHEN 0 THEN 'duplicate key value violates unique constraint "..."'
    WHEN 1 THEN 'process ... still waiting for ShareLock on transaction ... after ... ms'
    WHEN 2 THEN 'relation "" of ''...'' does not exist (...)'
    WHEN 3 THEN 'server process (...) was terminated by signal ...: Killed'
    WHEN 4 THEN 'invalid input syntax for type integer: ...'
    ELSE 'permission denied for table ...' END AS pattern FROM m)"""


@query(f"WITH {MESSAGES}, {PATTERNS} SELECT o_orderkey, pattern FROM p")
def normalize_error(spark, root):
    return messages(spark, root).select("o_orderkey", logs.normalize_error(F.col("message")).alias("pattern"))


@query(f"""
WITH {MESSAGES}, {PATTERNS}
SELECT o_orderkey, CASE WHEN severity = 'PANIC' THEN 'data_corruption' WHEN pattern LIKE '%Killed%' THEN 'resource' WHEN pattern LIKE '%still waiting for%' THEN 'lock' WHEN pattern LIKE '%duplicate key%' THEN 'constraint'
  WHEN pattern LIKE '%permission denied%' THEN 'auth' WHEN pattern LIKE '%does not exist%' OR pattern LIKE '%invalid input%' THEN 'syntax' WHEN severity = 'FATAL' THEN 'system' ELSE 'other' END AS category FROM p
""")
def classify_error(spark, root):
    return messages(spark, root).select("o_orderkey", logs.classify_error(logs.normalize_error(F.col("message")), F.col("severity")).alias("category"))


@query(f"""
WITH {MESSAGES}, {PATTERNS} SELECT severity, pattern, count(*) AS n FROM p GROUP BY 1, 2
""")
def log_error_groups(spark, root):
    m = messages(spark, root).select("severity", logs.normalize_error(F.col("message")).alias("pattern"))
    return m.groupBy("severity", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, o_orderkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'LOG' ELSE 'ERROR' END AS severity, CAST(o_orderkey || '.25' AS DOUBLE) AS slow_ms, 'select ' || o_custkey AS slow_sql FROM orders
""")
def parse_log_lines(spark, root):
    o = table(spark, root, "orders")
    line = F.concat(F.lit("2024-01-01 00:00:00.000 UTC ["), F.col("o_orderkey"), F.lit("] "), F.when(F.col("o_orderkey") % 2 == 0, "LOG").otherwise("ERROR"), F.lit(":  duration: "), F.col("o_orderkey"), F.lit(".25 ms  statement: select "), F.col("o_custkey"))
    rows = o.select("o_orderkey", *logs.parse_stderr(line))
    return rows.select("o_orderkey", "pid", "severity", *logs.parse_message(F.col("message"))).select("o_orderkey", "pid", "severity", "slow_ms", "slow_sql")


@query("""
SELECT s_suppkey, 'WARNING' AS level, 'closing because: idle' AS text, 'db' || s_nationkey AS database, 'u' || s_suppkey AS user, '10.0.0.1' AS host FROM supplier
""")
def parse_pooler_lines(spark, root):
    line = F.concat(F.lit("2024-01-01 00:00:00.000 UTC [7] WARNING C-0x5581: db"), F.col("s_nationkey"), F.lit("/u"), F.col("s_suppkey"), F.lit("@10.0.0.1:6432 closing because: idle"))
    return table(spark, root, "supplier").select("s_suppkey", *logs.parse_bouncer(line))
