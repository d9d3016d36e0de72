"""Several items from one scan, series blocks, assembled log records, trees of groups, devices, and the load of episodes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeloom.functions.timeutil import HOUR
from gaugeloom.operators import assembly, heatmap, links, processes, topology
from gaugeloom.plans.grids import COLUMNS, COUNTER, GAUGE, RATE_CELLS, TOP, _cells
from gaugeloom.plans.registry import DAY, REC, SPAN, query, recorded
from gaugeloom.plans.snapshots import MOMENTS, moments
from gaugeloom.sources.index import Index, Series
from gaugeloom.sources.tables import table


def _item(name: str, totals: str, cells: str, rows: str) -> str:
    return f"""SELECT '{name}' AS item, q.* FROM (WITH t AS ({totals}), {cells},
      r AS (SELECT user_id, total, CAST(row_number() OVER (ORDER BY total DESC NULLS LAST, CAST(user_id AS VARCHAR)) AS INTEGER) AS rank FROM t) {rows}) q"""


LAST = f"SELECT rank, user_id, total, col, arg_max(v, ts)::DOUBLE AS cell FROM p JOIN r USING (user_id) WHERE rank <= {TOP} GROUP BY ALL"
GROWN = f"SELECT rank, user_id, total, col, round(cell, 9) AS cell FROM c JOIN r USING (user_id) WHERE rank <= {TOP} AND cell IS NOT NULL"
ITEMS = {"cents": ("cents", "gauge"), "counter": ("counter", "counter"), "event": ("event_id", "gauge")}


@query(f"""
WITH {REC} {_item("cents", GAUGE, _cells("cents"), LAST)} UNION ALL {_item("counter", COUNTER, RATE_CELLS, GROWN)}
UNION ALL {_item("event", GAUGE.replace("cents", "event_id"), _cells("event_id"), LAST)}
""")
def grid_batch(spark, root):
    return heatmap.batch(recorded(spark, root), "user_id", ITEMS, SPAN, COLUMNS, TOP)[0].withColumn("cell", F.round("cell", 9))


SUMMED = f"SELECT col, round(sum(cell), 6) AS totals, round(sum(cell) FILTER (rank > {TOP}), 6) AS others, count(cell) AS contributors FROM c JOIN r USING (user_id) GROUP BY col HAVING count(cell) > 0"


@query(f"""
WITH {REC} {_item("cents", GAUGE, _cells("cents") + ", c AS (SELECT user_id, col, arg_max(v, ts) AS cell FROM p GROUP BY ALL)", SUMMED)} UNION ALL {_item("counter", COUNTER, RATE_CELLS, SUMMED)}
""")
def grid_batch_bands(spark, root):
    found = heatmap.batch(recorded(spark, root), "user_id", {k: ITEMS[k] for k in ("cents", "counter")}, SPAN, COLUMNS, TOP)[1]
    return found.select("item", "col", F.round("totals", 6).alias("totals"), F.round("others", 6).alias("others"), "contributors")


QUARTER = 92 * DAY
SERIES = [Series("calls", "calls", "rate"), Series("most", "n", "max"), Series("rows", "n", "sum")]


@query(f"""
WITH {MOMENTS}, k AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS past FROM (SELECT DISTINCT ts FROM m)),
r AS (SELECT c.ts, c.n, CASE WHEN c.calls >= p.calls THEN CAST(c.calls - p.calls AS DOUBLE) / ((c.ts - p.ts) / 1000000.0::DOUBLE) END AS x FROM m c JOIN k ON k.ts = c.ts LEFT JOIN m p ON p.pid = c.pid AND p.slot = c.slot AND p.ts = k.past),
s AS (SELECT ts, round(sum(x), 9) AS calls, max(n)::DOUBLE AS most, sum(n)::DOUBLE AS rows FROM r GROUP BY 1)
SELECT ts // {QUARTER} AS segment_id, ts, 'calls' AS series, calls AS value FROM s WHERE calls IS NOT NULL UNION ALL SELECT ts // {QUARTER}, ts, 'most', most FROM s UNION ALL SELECT ts // {QUARTER}, ts, 'rows', rows FROM s
""")
def index_block(spark, root):
    rows = moments(spark, root).withColumn("segment_id", F.floor(F.col("ts") / QUARTER))
    index = Index(spark, f"{links._shared(spark)}/index-{uuid.uuid4().hex}", ["pid", "slot"], SERIES)
    index.refresh(rows.where(F.col("ts") < 820_454_400_000_000))  # up to 1995, then what came since
    index.refresh(rows)
    return index.load().withColumn("value", F.round("value", 9))


@query("""
SELECT o_custkey % 3 AS source, o_orderkey * 4 AS first_place, CASE WHEN o_orderkey % 5 = 0 THEN 'FATAL' ELSE 'ERROR' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN '42P01' END AS sqlstate, o_custkey AS pid,
       'relation of ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'goes on ERROR:  ' || o_custkey ELSE '' END AS message,
       CASE WHEN o_orderkey % 4 < 2 THEN 'Key ' || o_orderpriority || CASE WHEN o_orderkey % 4 = 1 THEN chr(10) || 'and more' ELSE '' END END AS detail
FROM orders
""")
def assemble_stderr(spark, root):
    """Orders as log records of one to four lines, in files of a thousand places, so that records span files."""
    o = table(spark, root, "orders")
    head = "'2024-01-01 00:00:00.000 UTC [' || o_custkey || '] '"
    written = F.expr(f"""filter(array({head} || CASE WHEN o_orderkey % 5 = 0 THEN 'FATAL' ELSE 'ERROR' END || ':  ' || CASE WHEN o_orderkey % 2 = 0 THEN '42P01: ' ELSE '' END || 'relation of ' || o_orderkey,
      CASE WHEN o_orderkey % 3 = 0 THEN '\\tgoes on ERROR:  ' || o_custkey END, CASE WHEN o_orderkey % 4 < 2 THEN {head} || 'DETAIL:  Key ' || o_orderpriority END, CASE WHEN o_orderkey % 4 = 1 THEN '\\tand more' END), x -> x IS NOT NULL)""")
    lines = o.select((F.col("o_custkey") % 3).alias("source"), "o_orderkey", F.posexplode(written).alias("nth", "line")).withColumn("place", F.col("o_orderkey") * 4 + F.col("nth"))
    got = assembly.stderr(lines.withColumn("file", F.floor(F.col("place") / 1_000)), ["source"], "file", "place", prefix="%m [%p] ")
    return got.select("source", "first_place", "severity", "sqlstate", F.col("pid").cast("long").alias("pid"), "message", "detail")


@query("""
SELECT o_custkey % 3 AS source, o_orderkey * 8 AS first_place, o_custkey::VARCHAR AS process_id, 'ERROR' AS error_severity, '23505' AS sql_state_code, 'db,' || o_orderstatus AS database_name,
       'no "' || o_orderpriority || '"' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'second, "line"' || chr(10) || chr(10) || 'fourth' ELSE '' END AS message, CASE WHEN o_orderkey % 3 = 0 THEN 'detail ' || o_orderkey END AS detail
FROM orders
""")
def assemble_csv(spark, root):
    """Orders as records of a CSV log, some of several lines, in files of a thousand places."""
    record = F.expr("""'2024-01-01 00:00:00.000 UTC,"app","db,' || o_orderstatus || '",' || o_custkey || ',,s1,1,"INSERT",2024-01-01,3/4,0,ERROR,23505,"no ""' || o_orderpriority || '""'
      || CASE WHEN o_orderkey % 2 = 0 THEN '\\nsecond, ""line""\\n\\nfourth' ELSE '' END || '",' || CASE WHEN o_orderkey % 3 = 0 THEN '"detail ' || o_orderkey || '"' ELSE '' END || ',,,,,,,,"psql"'""")
    lines = table(spark, root, "orders").select((F.col("o_custkey") % 3).alias("source"), "o_orderkey", F.posexplode(F.split(record, "\n")).alias("nth", "line")).withColumn("place", F.col("o_orderkey") * 8 + F.col("nth"))
    got = assembly.csv(lines.withColumn("file", F.floor(F.col("place") / 1_000)), ["source"], "file", "place")
    return got.select("source", "first_place", "process_id", "error_severity", "sql_state_code", "database_name", "message", "detail")


#: Parts as control groups: makers, brands and parts, with more than their children have between them at two levels.
GROUPS = """g AS (
  SELECT 0 AS moment, '/' AS path, sum(p_size) + 5 AS mem FROM part UNION ALL SELECT 0, '/' || p_type, sum(p_size) FROM part GROUP BY p_type UNION ALL
  SELECT 0, '/' || p_type || '/' || p_brand, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE sum(p_size) + count(*) END FROM part GROUP BY p_type, p_brand UNION ALL
  SELECT 0, '/' || p_type || '/' || p_brand || '/' || p_partkey, p_size FROM part)"""


@query(f"""
WITH {GROUPS}, p AS (SELECT *, CASE WHEN path <> '/' THEN coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') END AS up FROM g),
c AS (SELECT up, count(*) AS children, sum(mem) AS s, bool_or(mem IS NULL) AS unknown FROM p WHERE up IS NOT NULL GROUP BY 1)
SELECT p.moment, p.path, coalesce(c.children, 0) AS children, CAST(p.mem AS BIGINT) AS mem, CAST(CASE WHEN NOT coalesce(c.unknown, false) AND p.mem IS NOT NULL THEN greatest(p.mem - coalesce(c.s, 0), 0) END AS BIGINT) AS mem_own FROM p LEFT JOIN c ON c.up = p.path
""")
def cgroup_residual(spark, root):
    p = table(spark, root, "part")
    size, n, brand = F.sum("p_size"), F.count(F.lit(1)), F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand")
    at = lambda rows, path, mem: rows.select(F.lit(0).alias("moment"), path.alias("path"), F.expr(mem).cast("long").alias("mem"))
    root_row = at(p.agg(size.alias("s")), F.lit("/"), "s + 5")
    makers = at(p.groupBy("p_type").agg(size.alias("s")), F.concat(F.lit("/"), "p_type"), "s")
    brands = at(p.groupBy("p_type", "p_brand").agg(size.alias("s"), n.alias("n")), brand, "CASE WHEN p_brand LIKE '%3' THEN NULL ELSE s + n END")
    groups = root_row.union(makers).union(brands).union(at(p, F.concat(brand, F.lit("/"), "p_partkey"), "p_size"))
    return topology.residuals(groups, ["moment"], ["mem"])


@query(f"""
WITH {REC} SELECT user_id, ts, CASE WHEN counter >= lag(counter) OVER w AND ts > lag(ts) OVER w THEN CAST(counter - lag(counter) OVER w AS DOUBLE) / ((ts - lag(ts) OVER w) / 1000000.0::DOUBLE) END AS counter_rate,
       CASE WHEN event_id >= lag(event_id) OVER w AND ts > lag(ts) OVER w THEN CAST(event_id - lag(event_id) OVER w AS DOUBLE) / ((ts - lag(ts) OVER w) / 1000000.0::DOUBLE) END AS event_id_rate
FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def device_rates(spark, root):
    return topology.device_rates(recorded(spark, root), ["user_id"], ["counter", "event_id"])


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 5 - 1 AS parent FROM part UNION ALL SELECT p_partkey, p_partkey // 3 + 1 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 3), f AS (SELECT child, min(parent) AS parent FROM e GROUP BY 1),
d AS (SELECT child AS device FROM e UNION SELECT parent FROM e), w AS (SELECT device, device AS at, [device] AS chain FROM d UNION ALL SELECT w.device, f.parent, list_append(chain, f.parent) FROM w JOIN f ON f.child = w.at)
SELECT device, array_to_string(max(chain), '>') AS chain FROM w GROUP BY 1
""")
def device_layers(spark, root):
    key = F.col("p_partkey")
    p = table(spark, root, "part")
    edges = p.select(key.alias("child"), (F.floor(key / 5) - 1).alias("parent")).union(p.where((key % 4 == 0) & (key > 3)).select(key, F.floor(key / 3) + 1))
    return topology.layers(edges).withColumn("chain", F.array_join(F.col("chain").cast("array<string>"), ">"))


@query(f"""
WITH {REC}, a AS (SELECT user_id, ts, counter, CASE WHEN (ts - lag(ts) OVER w) * 2 > 5 * {8 * HOUR} OR counter < lag(counter) OVER w THEN 1 ELSE 0 END AS s FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS episode FROM a), f AS (SELECT user_id, episode, min(ts) AS first_ts, max(ts) AS last_ts, max(counter) - min(counter) AS done FROM e GROUP BY ALL),
p AS (SELECT user_id, ts, counter AS utime, event_id AS stime, event_id * 10 AS read_bytes FROM rec WHERE event_id % 2 = 0),
b AS (SELECT f.*, p.ts AS b, p.utime AS bu, p.stime AS bs, p.read_bytes AS br FROM f ASOF LEFT JOIN p ON f.user_id = p.user_id AND f.first_ts >= p.ts),
x AS (SELECT b.*, p.ts AS a, p.utime AS au, p.stime AS s, p.read_bytes AS ar FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.last_ts >= p.ts),
l AS (SELECT *, CASE WHEN a > b THEN (a - b) / 1000000.0::DOUBLE END AS load_seconds, CASE WHEN a > b AND au >= bu AND s >= bs THEN au - bu + s - bs END AS cpu_ticks, CASE WHEN a > b AND ar >= br THEN ar - br END AS read_bytes FROM x)
SELECT user_id, episode, first_ts, last_ts, load_seconds, cpu_ticks, read_bytes, CASE WHEN load_seconds > 0 AND cpu_ticks IS NOT NULL THEN round(least(100.0, cpu_ticks * 10.0 / 10 / load_seconds), 9) END AS cpu_share, CASE WHEN done > 0 AND read_bytes IS NOT NULL THEN round(least(100.0, read_bytes * 100.0 / done), 9) END AS read_share FROM l
""")
def vacuum_load(spark, root):
    rows = recorded(spark, root)
    found = processes.vacuum_episodes(rows, ["user_id"], 8 * HOUR, "counter").select("user_id", "episode", "first_ts", "last_ts", "done")
    samples = rows.where("event_id % 2 = 0").select("user_id", "ts", F.col("counter").alias("utime"), F.col("event_id").alias("stime"), (F.col("event_id") * 10).alias("read_bytes"))
    got = processes.vacuum_load(found, samples, ["user_id"], 100, "done")
    return got.select("user_id", "episode", "first_ts", "last_ts", "load_seconds", "cpu_ticks", "read_bytes", F.round("cpu_share", 9).alias("cpu_share"), F.round("read_share", 9).alias("read_share"))


@query(f"""
WITH {REC}, a AS (SELECT user_id, ts, event_type, counter, CASE WHEN (ts - lag(ts) OVER w) * 2 > 5 * {8 * HOUR} OR counter < lag(counter) OVER w THEN 1 ELSE 0 END AS s FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS episode FROM a), l AS (SELECT *, last_value(event_type) OVER (PARTITION BY user_id, episode ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS phase FROM e),
b AS (SELECT user_id, episode, max(ts) AS broken FROM l WHERE event_type <> phase GROUP BY ALL)
SELECT l.user_id, l.episode, phase, min(ts) AS since, count(*) AS rows FROM l LEFT JOIN b USING (user_id, episode) WHERE broken IS NULL OR ts > broken GROUP BY ALL
""")
def vacuum_phase_runs(spark, root):
    from gaugeloom.operators.sequence import episodes

    return processes.phase_runs(episodes(recorded(spark, root), ["user_id"], 8 * HOUR, ["counter"]), ["user_id"], "event_type")
