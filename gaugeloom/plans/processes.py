"""Queries on processes, lanes, locks and maintenance, with tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.functions.timeutil import HOUR
from gaugeloom.operators import lanes, processes
from gaugeloom.operators.relations import running
from gaugeloom.plans.registry import EPOCH, REC, gauges, query, recorded
from gaugeloom.sources.tables import table


@query("""
WITH u AS (SELECT o_custkey % 50 AS uid, arg_max(o_orderpriority, o_orderkey) AS user FROM orders GROUP BY 1)
SELECT s_suppkey, s_suppkey % 60 AS uid, user FROM supplier LEFT JOIN u ON u.uid = s_suppkey % 60
""")
def user_names(spark, root):
    users = table(spark, root, "orders").select((F.col("o_custkey") % 50).alias("uid"), F.col("o_orderpriority").alias("user"), F.col("o_orderkey").alias("ts"))
    return processes.with_users(table(spark, root, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60).alias("uid")), users)


@query("SELECT p_partkey, p_size + p_partkey AS cpu_time_ticks FROM part")
def virtual_columns(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.col("p_size").cast("long").alias("utime"), F.col("p_partkey").alias("stime"))
    return processes.cpu_time(p).select("p_partkey", "cpu_time_ticks")


@query("""
WITH s AS (SELECT p_partkey AS queryid, p_type || p_name AS q FROM part), x AS (SELECT queryid FROM s WHERE starts_with(q, 'ECONOMY') AND queryid <> 0)
SELECT l_partkey % 300 AS queryid, count(*) AS n FROM lineitem WHERE l_partkey % 300 NOT IN (SELECT queryid FROM x) GROUP BY 1
""")
def statement_scope(spark, root):
    s = table(spark, root, "part").select(F.col("p_partkey").alias("queryid"), F.concat("p_type", "p_name").alias("query"))
    plans = table(spark, root, "lineitem").select((F.col("l_partkey") % 300).alias("queryid"))
    return processes.without_scope(s, plans, "ECONOMY", ["queryid"])[1].groupBy("queryid").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {REC}, h AS (SELECT (ts - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS ts, sum(cents) AS v FROM rec GROUP BY 1),
c AS (SELECT ts, CAST(sum(v) OVER (ORDER BY ts) AS BIGINT) AS v FROM h), l AS (SELECT ts, v, lag(v) OVER (ORDER BY ts) AS b, lag(ts) OVER (ORDER BY ts) AS p FROM c),
r AS (SELECT ts, CASE WHEN v >= b THEN CAST(v - b AS DOUBLE) / ((ts - p) / 1000000.0::DOUBLE) END AS x FROM l)
SELECT ts, 'disk_busy' AS key, CASE WHEN x IS NOT NULL THEN least(100.0, x / 10) END AS value FROM r UNION ALL SELECT ts, 'disk_queue', x / 1000 FROM r
""")
def lanes_disk(spark, root):
    hour = (F.floor((F.col("ts") - EPOCH) / HOUR) * HOUR + EPOCH).cast("long")
    grown = gauges(spark, root).groupBy(hour.alias("ts"), "event_type").agg(F.sum("cents").alias("v"))
    totals = running(grown.groupBy("ts").agg(F.sum("v").alias("v")), "ts", ["v"])
    return lanes.disks(totals.select("ts", F.col("v").alias("io_ms"), F.col("v").alias("weighted_ms")))


#: Running hourly sums c(ts, v), and their change per second r(ts, v, x).
HOURLY = f"""
WITH {REC}, h AS (SELECT (ts - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS ts, sum(cents) AS v FROM rec GROUP BY 1),
c AS (SELECT ts, CAST(sum(v) OVER (ORDER BY ts) AS BIGINT) AS v FROM h), l AS (SELECT ts, v, lag(v) OVER (ORDER BY ts) AS b, lag(ts) OVER (ORDER BY ts) AS p FROM c),
r AS (SELECT ts, v, CASE WHEN v >= b THEN CAST(v - b AS DOUBLE) / ((ts - p) / 1000000.0::DOUBLE) END AS x, (ts - {EPOCH}) // {HOUR} % 3 + 2 AS cores FROM l)"""


def hourly(spark, root):
    hour = (F.floor((F.col("ts") - EPOCH) / HOUR) * HOUR + EPOCH).cast("long")
    grown = gauges(spark, root).groupBy(hour.alias("ts")).agg(F.sum("cents").alias("v"))
    return running(grown, "ts", ["v"]).withColumn("cores", (F.floor((F.col("ts") - EPOCH) / HOUR) % 3 + 2).cast("int"))


def _lanes(**values: str) -> str:
    return HOURLY + " UNION ALL ".join(f" SELECT ts, '{key}' AS key, round({value}, 6) AS value FROM r" for key, value in values.items())


def _rounded(found):
    return found.select("ts", "key", F.round("value", 6).alias("value"))


@query(_lanes(cpu_busy="x / cores"))
def lanes_cpu(spark, root):
    rows = hourly(spark, root).select("ts", F.explode(F.sequence(F.lit(-1), F.col("cores") - 1)).alias("cpu_id"), F.col("v").alias("user"), *[F.lit(0).cast("long").alias(c) for c in ("nice", "system", "irq", "softirq", "steal")])
    return _rounded(lanes.cpu(rows))


@query(_lanes(cpu_stall="x / 10000", io_stall="2 * x / 10000"))
def lanes_stalls(spark, root):
    rows = hourly(spark, root).select("ts", F.lit(0).alias("scope"), F.explode(F.expr("array(struct(0 AS resource, v AS some_us), struct(1 AS resource, v * 9 AS some_us), struct(2 AS resource, v * 2 AS some_us))")).alias("p"))
    return _rounded(lanes.stalls(rows.select("ts", "scope", "p.*").unionByName(rows.select("ts", F.lit(1).alias("scope"), "p.*"))))


@query(_lanes(net_rx="3 * x", net_tx="6 * x", net_drop="3 * x", net_errors="6 * x"))
def lanes_network(spark, root):
    kinds = {"rx_bytes": "v", "tx_bytes": "v * 2", "rx_drop": "v", "tx_drop": "0", "rx_fifo": "0", "tx_fifo": "0", "rx_errs": "v", "tx_errs": "v"}
    each = hourly(spark, root).withColumn("v", F.explode(F.array(F.col("v"), F.col("v") * 2)))  # two interfaces
    return _rounded(lanes.network(each.select("ts", *[F.expr(e).cast("long").alias(n) for n, e in kinds.items()])))


@query(_lanes(memory="(8000000 - v % 1000000)::DOUBLE * 100 / 8000000", mem_swap="3 * x", mem_oom="x"))
def lanes_memory(spark, root):
    c = hourly(spark, root)
    used = c.select("ts", F.lit(8_000_000).cast("long").alias("total"), (F.col("v") % 1_000_000).alias("available"))
    return _rounded(lanes.memory(used, c.select("ts", F.col("v").alias("pswpin"), (F.col("v") * 2).alias("pswpout"), F.col("v").alias("oom_kill"))))


@query(_lanes(
    cg_cpu_cores="x / 1000000", cg_cpu_share="x / 1000000 * 100 / cores", cg_cpu_throttle="2 * x / 10000", cg_cpu_psi="x / 10000", cg_mem_psi="x / 10000", cg_io_psi="x / 10000", cg_io_read="x", cg_io_write="2 * x", cg_oom="x",
    cg_memory="(v % 5000)::DOUBLE * 100 / 5000", cg_memory_bytes="v % 5000", cg_pids="v % 70", cg_pids_share="(v % 70)::DOUBLE * 100 / 140",
))
def lanes_container(spark, root):
    c = hourly(spark, root)
    values = {"usage_us": "v", "throttled_us": "v * 2", "cpu_psi_us": "v", "mem_psi_us": "v", "io_psi_us": "v", "rbytes": "v", "wbytes": "v * 2", "oom_kill": "v", "memory": "v % 5000", "limit": "5000", "pids": "v % 70", "pids_max": "140"}
    rows = c.select("ts", F.explode(F.array(F.lit("/app"), F.lit("/other"))).alias("path"), *[F.expr(e).cast("long").alias(n) for n, e in values.items()])
    return _rounded(lanes.container(rows, c.select("ts", F.col("cores").cast("double").alias("cpus")), "/app"))


@query(f"""
WITH {REC}, h AS (SELECT (ts - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS ts, event_type, event_id, user_id FROM rec),
a AS (SELECT ts, count(*) FILTER (event_type = 'click' AND event_id % 3 = 0) AS pg_running, count(*) FILTER (event_type = 'click' AND event_id % 3 <> 0) AS pg_waiting, count(*) FILTER (event_id % 3 = 1) AS pg_lock_waiting FROM h GROUP BY 1)
SELECT ts, 'pg_running' AS key, CAST(pg_running AS DOUBLE) AS value FROM a UNION ALL SELECT ts, 'pg_waiting', pg_waiting FROM a UNION ALL SELECT ts, 'pg_lock_waiting', pg_lock_waiting FROM a UNION ALL SELECT ts, 'pg_oldest_xact', 7 FROM a
""")
def lanes_backends(spark, root):
    hour = (F.floor((F.col("ts") - EPOCH) / HOUR) * HOUR + EPOCH).cast("long")
    e = gauges(spark, root).select(
        hour.alias("ts"), F.when(F.col("event_type") == "click", "active").otherwise("idle").alias("state"), F.lit("client backend").alias("backend_type"), F.lit(None).cast("int").alias("leader_pid"),
        F.when(F.col("event_id") % 3 == 1, "Lock").when(F.col("event_id") % 3 == 2, "IO").alias("wait_event_type"), (hour - 7_000_000).alias("xact_start"),
    )
    return lanes.backends(e)


@query("""
WITH RECURSIVE r AS (SELECT p_partkey % 3 AS moment, p_partkey AS pid, CASE WHEN p_partkey % 9 = 0 THEN [] ELSE [p_partkey // 4, p_partkey // 7 * 3, p_partkey + 1000000, CASE WHEN p_partkey % 10 = 1 THEN 0 END] END AS b FROM part),
e AS (SELECT DISTINCT r.moment, r.pid, u.up FROM (SELECT moment, pid, unnest(b) AS up FROM r) u JOIN r USING (moment, pid) JOIN r AS x ON x.moment = r.moment AND x.pid = u.up WHERE u.up <> 0),
w AS (SELECT moment, pid, [pid] AS path FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.moment = r.moment AND e.pid = r.pid) UNION ALL SELECT e.moment, e.pid, list_append(w.path, e.pid) FROM w JOIN e ON e.moment = w.moment AND e.up = w.pid),
p AS (SELECT moment, pid, min(path) AS path FROM w GROUP BY ALL),
c AS (SELECT moment, pid, pid AS other FROM r UNION SELECT c.moment, c.pid, CASE WHEN e.up = c.other THEN e.pid ELSE e.up END FROM c JOIN e ON e.moment = c.moment AND (e.up = c.other OR e.pid = c.other)),
l AS (SELECT moment, pid, min(other) AS component FROM c GROUP BY ALL)
SELECT r.moment, r.pid, l.component, 0 AS tree, len(p.path) AS depth, CASE WHEN len(p.path) > 1 THEN p.path[len(p.path) - 1] END AS parent, list_contains(r.b, 0) AS waits_on_prepared, array_to_string(p.path, ' ') AS path,
       coalesce((SELECT string_agg(e.up, ' ' ORDER BY e.up) FROM e WHERE e.moment = r.moment AND e.pid = r.pid AND e.up IS DISTINCT FROM CASE WHEN len(p.path) > 1 THEN p.path[len(p.path) - 1] END), '') AS extra_blockers
FROM r JOIN p USING (moment, pid) JOIN l USING (moment, pid)
""")
def lock_forest(spark, root):
    key = F.col("p_partkey")
    blockers = F.array(F.floor(key / 4), F.floor(key / 7) * 3, key + 1_000_000, F.when(key % 10 == 1, 0))
    p = table(spark, root, "part").select((key % 3).alias("moment"), key.alias("pid"), F.when(key % 9 != 0, F.filter(blockers, lambda b: b.isNotNull())).otherwise(F.array().cast("array<bigint>")).alias("blocked_by"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return processes.lock_forest(p, ["moment"]).select("moment", "pid", "component", "tree", "depth", "parent", "waits_on_prepared", text("path"), text("extra_blockers"))


@query("""
WITH RECURSIVE k AS (SELECT p_partkey AS c FROM part WHERE p_size = 7 UNION SELECT c // 2 FROM k WHERE c % 10 <> 0)
SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT c FROM k)
""")
def process_tree_filter(spark, root):
    p = table(spark, root, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 10 != 0, F.floor(F.col("p_partkey") / 2)).alias("up"))
    return processes.with_ancestors(p, F.col("p_size") == 7, "p_partkey", "up").select("p_partkey", "p_size")


@query(f"""
WITH {REC}, a AS (SELECT user_id, ts, counter, CASE WHEN (ts - lag(ts) OVER w) * 2 > 5 * {8 * HOUR} OR counter < lag(counter) OVER w THEN 1 ELSE 0 END AS s FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS episode FROM a)
SELECT user_id, episode, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS samples, max(counter) - min(counter) AS done, count(*) FILTER (counter = m) >= 3 AS stuck
FROM (SELECT *, max(counter) OVER (PARTITION BY user_id, episode) AS m FROM e) GROUP BY ALL
""")
def vacuum_episodes(spark, root):
    return processes.vacuum_episodes(recorded(spark, root), ["user_id"], 8 * HOUR, "counter")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey > 0 AND o_orderkey - o_custkey >= 0 THEN CAST(o_orderkey - o_custkey AS DOUBLE) / 1000000 END AS age FROM orders
""")
def activity_age(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("start"), F.col("o_orderkey").alias("ts"))
    return o.select("o_orderkey", processes.activity_age(o, "start", ["O", "P"]).alias("age"))
