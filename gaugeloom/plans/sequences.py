"""Series over the recorded events: rates, summaries, health, findings, episodes, forests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeloom.functions import ratios
from gaugeloom.functions.counters import adjacent, asof, predecessor, rate
from gaugeloom.functions.timeutil import HOUR
from gaugeloom.operators import detect, sequence, series
from gaugeloom.plans.registry import DAY, EPOCH, REC, gauges, query, recorded
from gaugeloom.sources.tables import table


def _adjacent(value: str) -> str:
    return f"""
a AS (SELECT *, {value} AS v, lag({value}) OVER w AS before, lag(ts) OVER w AS prev_ts FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, CASE WHEN v >= before THEN v - before END AS delta, CASE WHEN v >= before AND ts > prev_ts THEN CAST(v - before AS DOUBLE) / ((ts - prev_ts) / 1000000.0::DOUBLE) END AS rate FROM a)"""


@query(f"WITH {REC}, {_adjacent('counter')} SELECT event_id, user_id, prev_ts, delta, rate FROM r")
def adjacent_rate(spark, root):
    return adjacent(recorded(spark, root), ["user_id"], "counter").select("event_id", "user_id", "prev_ts", "delta", "rate")


NULLABLE = "CASE WHEN event_id % 7 <> 0 THEN counter END"


@query(f"WITH {REC}, {_adjacent(NULLABLE)} SELECT event_id, user_id, delta, rate FROM r")
def nullable_rate(spark, root):
    return adjacent(recorded(spark, root).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("counter"))), ["user_id"], "v").select("event_id", "user_id", "delta", "rate")


@query(f"""
WITH {REC}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) * 3 AS n FROM rec),
a AS (SELECT event_id, user_id, n, ts, lag(n) OVER w AS b, lag(ts) OVER w AS p FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id, CASE WHEN ts > p AND n >= b THEN CAST(n - b AS DOUBLE) / ((ts - p) / 1000000.0::DOUBLE) END AS tps FROM a
""")
def tps_by_entity(spark, root):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    rows = gauges(spark, root).withColumn("commits", nth * 2).withColumn("rollbacks", nth)
    return series.tps(rows, "user_id", "commits", "rollbacks").select("event_id", "user_id", "tps")


@query(f"""
WITH {REC}, h AS (SELECT ts // {HOUR} * {HOUR} AS ts, sum(cents) AS cents FROM rec GROUP BY 1),
a AS (SELECT ts, CAST(cents AS BIGINT) AS cents, CAST(lag(cents) OVER (ORDER BY ts) AS BIGINT) AS b, lag(ts) OVER (ORDER BY ts) AS p FROM h)
SELECT ts, cents, CASE WHEN cents >= b THEN CAST(cents - b AS DOUBLE) / ((ts - p) / 1000000.0::DOUBLE) END AS rate FROM a
""")
def sum_then_rate(spark, root):
    hourly = gauges(spark, root).withColumn("ts", (F.floor(F.col("ts") / HOUR) * HOUR).cast("long"))
    return series.sum_then_rate(hourly, "cents", DAY).select("ts", "cents", "rate")


@query(f"""
WITH {REC}, d AS (SELECT ts // {DAY} * {DAY} AS ts, user_id, max(cents) AS cents FROM rec GROUP BY 1, 2),
t AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT ts FROM d)),
a AS (SELECT d.*, p.cents AS b FROM d JOIN t USING (ts) LEFT JOIN d p ON p.ts = t.prev_ts AND p.user_id = d.user_id)
SELECT ts, count(*) AS entities, count(*) FILTER (cents >= b) AS usable, CAST(sum(CASE WHEN cents >= b THEN cents - b END) AS BIGINT) AS change, CAST(sum(cents) AS BIGINT) AS weight, count(*) FILTER (cents > 5000) AS large FROM a GROUP BY 1
""")
def process_summary(spark, root):
    rows = _daily(spark, root).withColumn("w", F.col("cents"))
    got = series.process_summary(rows, ["user_id"], ["cents"], ["w"], {"large": F.col("cents") > 5000})
    return got.select("ts", "entities", F.col("cents_usable").alias("usable"), F.col("cents_change").alias("change"), F.col("w").alias("weight"), "large")


def _daily(spark, root):
    day = (F.floor(F.col("ts") / DAY) * DAY).cast("long")
    return gauges(spark, root).groupBy(day.alias("ts"), "user_id").agg(F.max("cents").alias("cents"))


@query(f"""
WITH {REC}, d AS (SELECT ts // {DAY} * {DAY} AS ts, user_id, max(cents) AS cents FROM rec GROUP BY 1, 2),
t AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts FROM (SELECT DISTINCT ts FROM d))
SELECT d.ts, d.user_id, d.cents, t.prev_ts, p.cents AS prev_cents FROM d JOIN t USING (ts) LEFT JOIN d p ON p.ts = t.prev_ts AND p.user_id = d.user_id
""")
def moment_predecessor(spark, root):
    return predecessor(_daily(spark, root), ["user_id"], ["cents"]).select("ts", "user_id", "cents", "prev_ts", "prev_cents")


PSI = f"""
b AS (SELECT (ts - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS ts, event_type, sum(cents) * 40000 AS v FROM rec GROUP BY 1, 2),
c AS (SELECT ts, event_type, CAST(sum(v) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS v FROM b),
p AS (SELECT ts, max(v) FILTER (event_type = 'click') AS cpu, max(v) FILTER (event_type = 'view') AS memory, max(v) FILTER (event_type = 'error') AS io FROM c GROUP BY 1),
l AS (SELECT *, ts - lag(ts) OVER w AS e, cpu - lag(cpu) OVER w AS dc, memory - lag(memory) OVER w AS dm, io - lag(io) OVER w AS di FROM p WINDOW w AS (ORDER BY ts)),
h AS (SELECT ts, CASE WHEN dc >= 0 AND dm >= 0 AND di >= 0 THEN CAST(100 - (least(greatest(dc, dm, di), e) * 100 + e // 2) // e AS INTEGER) END AS os_health FROM l)"""


def _health(spark, root):
    hour = (F.floor((F.col("ts") - EPOCH) / HOUR) * HOUR + EPOCH).cast("long")
    sums = gauges(spark, root).groupBy(hour.alias("ts"), "event_type").agg((F.sum("cents") * 40_000).alias("v"))
    grown = sums.withColumn("v", F.sum("v").over(Window.partitionBy("event_type").orderBy("ts")))
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("v")))
    wide = grown.groupBy("ts").agg(of("click").alias("cpu"), of("view").alias("memory"), of("error").alias("io"))
    return series.os_health(wide.withColumn("host", F.lit(1)), ["host"]).select("ts", "os_health")


@query(f"WITH {REC}, {PSI} SELECT ts, os_health FROM h")
def health_score(spark, root):
    return _health(spark, root)


@query(f"""
WITH {REC}, {PSI}, a AS (SELECT (ts - {EPOCH}) // {HOUR} * {HOUR} + {EPOCH} AS ts, count(*) AS active FROM rec GROUP BY 1)
SELECT h.ts, CASE WHEN os_health IS NOT NULL THEN CAST(greatest(0, os_health - CASE WHEN active <= 8 THEN 0 ELSE round(100.0 * (active - 8) / active) END) AS INTEGER) END AS health FROM h JOIN a USING (ts)
""")
def overall_health(spark, root):
    hour = (F.floor((F.col("ts") - EPOCH) / HOUR) * HOUR + EPOCH).cast("long")
    active = gauges(spark, root).groupBy(hour.alias("ts")).agg(F.count(F.lit(1)).alias("active"))
    return _health(spark, root).join(active, "ts").select("ts", series.overall_health(F.col("os_health"), series.postgres_penalty(F.col("active"), F.lit(4.0))).cast("int").alias("health"))


@query(f"""
WITH {REC}, l AS (SELECT event_id, user_id, ts FROM rec WHERE event_type = 'purchase'),
  r AS (SELECT user_id, ts AS then, CASE WHEN cents % 5 = 0 THEN -1 ELSE cents * 7 - 14 END AS q, cents % 9 * 10 AS period, cents % 16 AS cpus FROM rec WHERE event_type = 'view')
SELECT event_id, CASE WHEN q = -1 THEN CAST(cpus AS DOUBLE) WHEN q > 0 AND period > 0 THEN least(CAST(q AS DOUBLE) / period, cpus) END AS capacity
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.then
""")
def capacity_asof(spark, root):
    e = gauges(spark, root)
    limits = e.where("event_type = 'view'").select("user_id", "ts", F.when(F.col("cents") % 5 == 0, -1).otherwise(F.col("cents") * 7 - 14).alias("q"), (F.col("cents") % 9 * 10).alias("period"), (F.col("cents") % 16).alias("cpus"))
    moments = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    held = asof(moments, limits, ["user_id"], ["q", "period", "cpus"])
    return held.select("event_id", ratios.cpu_capacity(F.col("q"), F.col("period"), F.col("cpus")).alias("capacity"))


@query(f"WITH {REC} SELECT 'slow_query' AS detector, CAST(user_id AS VARCHAR) || '/' || event_type AS entity, ts FROM rec WHERE cents >= 5000")
def detect_threshold(spark, root):
    e = gauges(spark, root).withColumn("max_duration_ms", F.col("cents"))
    return detect.crossing(e, "slow_query", detect.THRESHOLDS["slow_query"], ["user_id", "event_type"])


HOST = {
    "busy_delta": "p_size", "total_delta": "60", "load1": "p_size % 20", "cpus": "p_partkey % 5", "available": "p_size * 4", "total": "400", "free": "p_size * 6",
    "xid_age": "p_size * 40000000", "health": "p_size * 2", "active": "p_size % 11",
}
CROSSED = {
    "host_cpu": "busy_delta >= 0.8 * total_delta", "load": "load1 >= 2 * cpus", "memory": "available <= total / 10.0", "filesystem": "total - free >= 0.9 * total",
    "xid_age": "xid_age >= 1600000000", "overall_health": "health < 50", "active_backends": "active > 2 * cpus",
}


@query(f"""
WITH p AS (SELECT p_partkey, {", ".join(f"CAST({v} AS BIGINT) AS {n}" for n, v in HOST.items())} FROM part)
{" UNION ALL ".join(f"SELECT '{n}' AS detector, CAST(p_partkey AS VARCHAR) AS entity, CAST(p_partkey AS BIGINT) AS ts FROM p WHERE {c}" for n, c in CROSSED.items())}
""")
def detect_host_thresholds(spark, root):
    rows = table(spark, root, "part").select(F.col("p_partkey"), F.col("p_partkey").cast("long").alias("ts"), *[F.expr(v).cast("long").alias(n) for n, v in HOST.items()])
    return detect.crossings(rows, list(CROSSED), ["p_partkey"])


RISEN = "SELECT 'deadlocks' AS detector, CAST(user_id AS VARCHAR) AS entity, ts FROM (SELECT user_id, ts, counter, lag(counter) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM rec) WHERE counter > b"


@query(f"WITH {REC} {RISEN}")
def detect_counter_increase(spark, root):
    return detect.risen(recorded(spark, root), "deadlocks", "counter", ["user_id"])


#: Counters made of the recorded one; some rows lack them.
MADE = {"oom_kill": "counter", "cgroup_oom_kill": "counter // 7", "failed_count": "CASE WHEN event_id % 3 > 0 THEN counter END", "checksum_failures": "cents // 900", "sessions_fatal": "counter // 5000", "sessions_killed": "CASE WHEN event_id % 2 = 0 THEN cents // 400 END"}
SINCE = "{0} > last_value({0} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""
WITH {REC}, m AS (SELECT user_id, ts, {", ".join(f"{e} AS {n}" for n, e in MADE.items())} FROM rec),
f AS (SELECT user_id, ts, {", ".join(f"{SINCE.format(n)} AS {n}" for n in MADE)} FROM m)
SELECT 'host_oom' AS detector, CAST(user_id AS VARCHAR) AS entity, ts FROM f WHERE oom_kill UNION ALL SELECT 'cgroup_oom', CAST(user_id AS VARCHAR), ts FROM f WHERE cgroup_oom_kill
UNION ALL SELECT 'archiver', CAST(user_id AS VARCHAR), ts FROM f WHERE failed_count UNION ALL SELECT 'checksum', CAST(user_id AS VARCHAR), ts FROM f WHERE checksum_failures
UNION ALL SELECT 'sessions', CAST(user_id AS VARCHAR), ts FROM f WHERE coalesce(sessions_fatal, false) OR coalesce(sessions_killed, false)
""")
def detect_risen_counters(spark, root):
    rows = recorded(spark, root).select("user_id", "ts", *[F.expr(e.replace("//", "div")).alias(n) for n, e in MADE.items()])
    return detect.risen_counters(rows, ["host_oom", "cgroup_oom", "archiver", "checksum", "sessions"], ["user_id"])


@query("""
WITH c AS (SELECT o_custkey, o_orderkey % 40 AS ts, count(DISTINCT o_orderkey % 4) AS cpus FROM orders WHERE o_orderkey % 7 > 0 GROUP BY ALL)
SELECT 'load' AS detector, CAST(c_custkey AS VARCHAR) AS entity, CAST(t AS BIGINT) AS ts FROM customer, range(40) r(t) JOIN c ON true WHERE c.o_custkey = c_custkey AND c.ts = t AND (c_nationkey + t) % 9 / 2.0 >= 2 * cpus
""")
def detect_load(spark, root):
    """Customers as hosts of up to four processors, seen at forty times."""
    o = table(spark, root, "orders").where("o_orderkey % 7 > 0")
    cpus = o.select(F.col("o_custkey").alias("host"), (F.col("o_orderkey") % 40).alias("ts"), F.explode(F.array(F.col("o_orderkey") % 4, F.lit(-1).cast("long"))).alias("cpu_id"), F.lit(0).alias("scope"))
    loads = table(spark, root, "customer").select(F.col("c_custkey").alias("host"), "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("t"))
    loads = loads.select("host", F.col("t").cast("long").alias("ts"), ((F.col("c_nationkey") + F.col("t")) % 9 / 2).alias("load1"), F.lit(0).alias("scope"))
    return detect.load(loads, cpus, ["host"])


@query("""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS entity, CAST(p_partkey AS BIGINT) AS ts, p_size FROM part)
SELECT 'mxid_age' AS detector, entity, ts FROM p WHERE p_size * 40000000 >= 1600000000 UNION ALL SELECT 'data_corruption', entity, ts FROM p WHERE p_size % 9 = 5 UNION ALL SELECT 'lock_contention', entity, ts FROM p WHERE p_size % 4 = 1
UNION ALL SELECT 'pg_log', CAST(user_id AS VARCHAR), epoch_us(ts) FROM events WHERE event_type = 'error' UNION ALL SELECT 'pooler_log', CAST(user_id AS VARCHAR), epoch_us(ts) FROM events WHERE event_type = 'signup'
""")
def detect_states_and_events(spark, root):
    size = F.col("p_size").cast("long")
    p = table(spark, root, "part").select("p_partkey", F.col("p_partkey").cast("long").alias("ts"), (size * 40_000_000).alias("mxid_age"), (size % 9).alias("category"), F.expr("CASE WHEN p_size % 4 = 1 THEN array(1) ELSE CAST(array() AS array<int>) END").alias("blocked_by"))
    e = gauges(spark, root)
    logs = detect.events({"pg_log": e.where("event_type = 'error'"), "pooler_log": e.where("event_type = 'signup'")}, ["user_id"])
    return detect.crossings(p, ["mxid_age", "data_corruption", "lock_contention"], ["p_partkey"]).unionByName(logs)


@query(f"""
WITH {REC}, f AS (SELECT 'error' AS detector, CAST(user_id AS VARCHAR) AS entity, ts FROM rec WHERE event_type = 'error' UNION {RISEN})
SELECT *, (SELECT count(*) FROM f) AS found FROM f ORDER BY ts, detector, entity LIMIT 4096
""")
def findings_capped(spark, root):
    e = recorded(spark, root)
    return detect.findings([detect.crossing(e, "error", "event_type = 'error'", ["user_id"]), detect.risen(e, "deadlocks", "counter", ["user_id"])])


@query(f"""
WITH {REC} SELECT event_type, min(cents) AS least, max(cents) AS most, arg_max(cents, ts) AS latest, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.9) AS p90, quantile_disc(cents, 0.99) AS p99 FROM rec GROUP BY 1
""")
def series_percentiles(spark, root):
    return sequence.statistics(gauges(spark, root), ["event_type"], "cents")


@query(f"""
WITH {REC}, a AS (SELECT user_id, cents, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t FROM rec)
SELECT user_id, CAST(sum(CAST(cents AS HUGEINT) * t) AS DOUBLE) / 1000000 AS integral FROM a GROUP BY 1
""")
def rate_integral(spark, root):
    return sequence.integral(gauges(spark, root).withColumn("cents", F.col("cents").cast("decimal(12,0)")), ["user_id"], "cents").select("user_id", F.col("integral").cast("double").alias("integral"))


@query(f"""
WITH {REC}, a AS (SELECT event_id, user_id, ts, CASE WHEN (ts - lag(ts) OVER w) * 2 > 5 * {6 * HOUR} OR counter < lag(counter) OVER w THEN 1 ELSE 0 END AS s FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS episode FROM a
""")
def episodes(spark, root):
    return sequence.episodes(recorded(spark, root), ["user_id"], 6 * HOUR, ["counter"]).select("event_id", "user_id", "episode")


@query(f"""
WITH {REC}, a AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM rec)
SELECT event_id, user_id, event_type FROM a WHERE event_type IS DISTINCT FROM b
""")
def setting_changes(spark, root):
    return sequence.changes(gauges(spark, root), ["user_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey // 2 END AS up FROM part),
walk AS (SELECT node, node AS root, 0 AS level FROM e WHERE up IS NULL UNION ALL SELECT e.node, w.root, w.level + 1 FROM e JOIN walk w ON e.up = w.node)
SELECT * FROM walk
""")
def forest(spark, root):
    key = F.col("p_partkey")
    edges = table(spark, root, "part").select(key.alias("pid"), F.when(key % 10 != 0, F.floor(key / 2)).alias("ppid"))
    return sequence.forest(edges, "pid", "ppid", cycles=True)


@query("""
SELECT s_nationkey, CAST(sum(CAST(s_acctbal * 100 AS BIGINT) * s_suppkey) AS DOUBLE) / nullif(CAST(sum(s_suppkey) AS DOUBLE), 0) AS mean FROM supplier GROUP BY 1
""")
def weighted_mean(spark, root):
    s = table(spark, root, "supplier").withColumn("cents", F.round(F.col("s_acctbal") * 100).cast("long"))
    return s.groupBy("s_nationkey").agg(sequence.weighted_mean("cents", "s_suppkey").alias("mean"))


@query(f"""
WITH {REC}, a AS (SELECT event_id, cents, counter, lag(cents) OVER w AS bx, lag(counter) OVER w AS bc FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, CAST(CASE WHEN cents >= bx THEN cents - bx END AS DOUBLE) / nullif(CAST(CASE WHEN counter >= bc THEN counter - bc END AS DOUBLE), 0) AS rows_per_call FROM a
""")
def statement_ratios(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts")
    d = lambda c: F.when(F.col(c) >= F.lag(c).over(w), F.col(c) - F.lag(c).over(w))
    rows = recorded(spark, root).select("event_id", d("cents").alias("d_rows"), d("counter").alias("d_calls"))
    return rows.select("event_id", *ratios.derived(ratios.STATEMENT, set(rows.columns)))


@query(f"""
WITH {REC}, a AS (SELECT event_id, ts, counter, lag(ts) OVER w AS p, lag(counter) OVER w AS b FROM rec WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, CASE WHEN ts > p AND counter >= b THEN CAST(counter - b AS DOUBLE) / ((ts - p) / 1000000.0::DOUBLE) END AS rate FROM a
""")
def counter_pair_rate(spark, root):
    w = Window.partitionBy("user_id").orderBy("ts")
    e = recorded(spark, root).where("event_type = 'click'")
    return e.select("event_id", rate(F.lag("counter").over(w), F.col("counter"), F.lag("ts").over(w), F.col("ts")).alias("rate"))


@query(f"""
WITH {REC}, d AS (SELECT ts // {DAY} * {DAY} AS ts, user_id, max(cents) AS a, sum(cents) AS b FROM rec GROUP BY 1, 2),
l AS (SELECT ts, ts - lag(ts) OVER w AS e, CASE WHEN a >= lag(a) OVER w THEN a - lag(a) OVER w END AS da, CASE WHEN b >= lag(b) OVER w THEN b - lag(b) OVER w END AS db FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT ts, count(*) AS entities, round(sum(CAST(da AS DOUBLE) * 1000000 / e), 9) AS a_per_s, round(sum(CAST(db AS DOUBLE) * 1000000 / e), 9) AS b_per_s,
       CAST(sum(da) FILTER (db IS NOT NULL) AS DOUBLE) / nullif(CAST(sum(db) FILTER (da IS NOT NULL) AS DOUBLE), 0) AS share FROM l GROUP BY 1
""")
def surface_summary(spark, root):
    day = (F.floor(F.col("ts") / DAY) * DAY).cast("long")
    d = gauges(spark, root).groupBy(day.alias("ts"), "user_id").agg(F.max("cents").alias("a"), F.sum("cents").alias("b"))
    got = series.surface_summary(d, ["user_id"], ["a", "b"], {"share": ("a", "b")})
    return got.withColumns({c: F.round(c, 9) for c in ("a_per_s", "b_per_s")})


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END AS s, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 5 END AS i, l_suppkey % 4 AS x, l_partkey % 3 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(coalesce(s, i) IS NOT NULL AS BOOLEAN) AND true AS known,
       CASE WHEN coalesce(s, 0) + coalesce(i, 0) > 0 AND s IS NOT NULL THEN s * 100.0::DOUBLE / (coalesce(s, 0) + coalesce(i, 0)) END AS sequential_share_pct,
       CASE WHEN coalesce(s, i) IS NOT NULL THEN coalesce(s, 0) + coalesce(i, 0) END AS tuple_throughput, x + y + l_linenumber AS dml_total,
       CASE WHEN coalesce(s, i) IS NOT NULL THEN coalesce(s, 0) + coalesce(i, 0) END AS displayed_storage_bytes,
       CASE WHEN coalesce(s, 0) + coalesce(i, 0) + x + y > 0 THEN (coalesce(i, 0) + y) * 100.0::DOUBLE / (coalesce(s, 0) + coalesce(i, 0) + x + y) END AS buffer_hit_pct,
       CASE WHEN y > 0 THEN x / y::DOUBLE END AS autovacuum_mean_ms
FROM l
""")
def relation_metrics(spark, root):
    li, n = table(spark, root, "lineitem"), F.col("l_linenumber")
    s, i, x, y = F.when(n > 1, F.col("l_quantity").cast("long")), F.when(n % 3 > 0, F.col("l_partkey") % 5), F.col("l_suppkey") % 4, F.col("l_partkey") % 3
    null = F.lit(None).cast("long")
    have = {"d_seq_scan": s, "d_idx_scan": i, "r_seq_tup_read": s, "r_idx_tup_fetch": i, "r_n_tup_ins": x, "r_n_tup_upd": y, "r_n_tup_del": n, "main_bytes": s, "toast_bytes": i, "d_total_autovacuum_time": x, "d_autovacuum_count": y}
    have |= {"d_heap_blks_read": s, "d_heap_blks_hit": i, "d_idx_blks_read": x, "d_idx_blks_hit": y} | {f"d_{p}_blks_{k}": null for p in ("toast", "tidx") for k in ("read", "hit")}
    rows = li.select("l_orderkey", "l_linenumber", F.coalesce(s, i).isNotNull().alias("known"), *[v.alias(k) for k, v in have.items()])
    names = ["sequential_share_pct", "displayed_storage_bytes", "buffer_hit_pct", "autovacuum_mean_ms"]
    got = rows.select("l_orderkey", "l_linenumber", "known", *ratios.derived(ratios.TABLE, set(rows.columns)), *ratios.derived(ratios.RATES, set(rows.columns), "r_"))
    return got.select("l_orderkey", "l_linenumber", "known", *names, "tuple_throughput", "dml_total")


@query("SELECT l_suppkey, count(*) FILTER (l_partkey % 5 = 0 AND l_linenumber > 1) AS no_scan_count, count(*) FILTER (l_linenumber > 1) AS known_scan_count FROM lineitem GROUP BY 1")
def index_scan_counts(spark, root):
    rows = table(spark, root, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_partkey") % 5).alias("d_idx_scan"))
    return rows.groupBy("l_suppkey").agg(*ratios.scan_counts())
