"""A finder query for each surface, and searches by typed conditions: lineitems as snapshots, a moment per ship month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gaugeloom.functions import conditions
from gaugeloom.functions.conditions import Condition
from gaugeloom.operators import finders, relations
from gaugeloom.plans.registry import ORACLE_SQL, QUERIES, query
from gaugeloom.plans.snapshots import MOMENTS, moments

FOUND_AT = 896_659_200_000_000  # 1998-06-01

#: In SQL: c is the current moment's row, p the same entity's in the moment before.
RATE_OF = "CASE WHEN c.{0} >= p.{0} THEN CAST(c.{0} - p.{0} AS DOUBLE) / ((c.ts - p.ts) / 1000000.0::DOUBLE) END"


def _finder(name: str, columns: dict[str, str], wanted: Callable[[conditions.Fields], Condition], where: str, order: str, limit: int = 20, own: str = "false") -> None:
    """Registers find_<name>: `columns` gives each column of the surface as an expression, `where` the condition in SQL over the result."""
    surface = finders.SURFACES[name]
    counters = [c for c in surface.counters if c in columns]
    shown = [f"{RATE_OF.format(c) if c in counters else 'c.' + c} AS {c}" for c in columns]
    part = surface.partition
    of = f"PARTITION BY {part}" if part else ""
    sql = f"""
WITH {MOMENTS}, s AS (SELECT ts, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM m WHERE ts <= {FOUND_AT}),
t AS (SELECT DISTINCT ts{', ' + part if part else ''} FROM s), k AS (SELECT *, row_number() OVER ({of} ORDER BY ts DESC) AS nth FROM t),
c AS (SELECT s.* FROM s JOIN k USING (ts{', ' + part if part else ''}) WHERE nth = 1), p AS (SELECT s.* FROM s JOIN k USING (ts{', ' + part if part else ''}) WHERE nth = 2),
r AS (SELECT c.ts, {', '.join(shown)} FROM c LEFT JOIN p ON {' AND '.join(f'p.{k} = c.{k}' for k in surface.identity)}),
f AS (SELECT *, {own} AS own FROM r WHERE {where}), e AS (SELECT count(*) FILTER (NOT own) AS eligible, count(*) FILTER (own) AS excluded FROM f)
SELECT f.* EXCLUDE (own), e.eligible, e.eligible > {limit} AS truncated, e.excluded FROM f, e WHERE NOT own ORDER BY {order} DESC NULLS LAST, {', '.join(surface.identity)} LIMIT {limit}
"""

    def run(spark, root):
        rows = moments(spark, root).select("ts", *[F.expr(e).alias(n) for n, e in columns.items()])
        return finders.find(rows, surface, FOUND_AT, order=order, limit=limit, wanted=wanted(conditions.of(name)), own=F.expr(own))

    run.__name__ = f"find_{name}"
    QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, sql


KEY, NAMED = "pid * 7 + slot", "'Worker-' || CAST(slot AS STRING)"

_finder(
    "processes", {"pid": KEY, "starttime": "0", "comm": NAMED, "cmdline": "CAST(pid AS STRING)", "num_threads": "n", "utime": "calls", "stime": "n"},
    lambda f: f["command"].matches("w?rker-*") & (f["cpu_cores"].above("0.000000100") | f["threads"].above("3")), "((utime + stime) / 100 > 0.0000001 OR num_threads > 3)", "utime",
)
_finder(
    "activity", {"pid": KEY, "state": "CASE WHEN slot < 4 THEN 'active' ELSE 'idle in transaction' END", "query": NAMED, "backend_xid_age": "calls"},
    lambda f: f["state"].matches("IDLE") & f["backend_xid_age"].above("30") | f["pid"].equals(700), "(state LIKE 'idle%' AND backend_xid_age > 30 OR pid = 700)", "backend_xid_age",
)
_finder(
    "locks", {"pid": "pid", "target": "slot", "lock_mode": "CASE slot % 3 WHEN 0 THEN 'ShareLock' WHEN 1 THEN 'ExclusiveLock' ELSE 'RowShareLock' END", "weight": "n"},
    lambda f: f["mode"].any_of(["sharelock", "exclusivelock"]), "lower(lock_mode) IN ('sharelock', 'exclusivelock')", "weight",
)
_finder(
    "vacuum", {"pid": KEY, "phase": "CASE WHEN slot = 0 THEN 'scanning heap' ELSE 'vacuuming indexes' END", "heap_blks_scanned": "calls", "heap_blks_total": "calls + n"},
    lambda f: f["phase"].contains("heap") & f["heap_blks_scanned"].below("60"), "phase LIKE '%heap%' AND heap_blks_scanned < 60", "heap_blks_total",
)
_finder(
    "databases", {"datid": KEY, "datname": NAMED, "numbackends": "n", "xact_commit": "calls"},
    lambda f: conditions.filters("databases", [{"field": "database", "op": "contains", "value": "-5"}, {"field": "numbackends", "op": "gt", "value": 1}]), "datname LIKE '%-5%' AND numbackends > 1", "xact_commit",
)
_finder(
    "statements", {"queryid": "slot", "userid": "pid % 3", "dbid": "pid", "calls": "calls", "rows": "n", "total_exec_time": "calls * 3 + n"},
    lambda f: f["call_rate"].above("0.000001/s") & f["mean_exec"].above("3.01ms") & f["rows_per_call"].below("0.2"), "calls > 0.000001 AND total_exec_time / calls > 3.01 AND rows / calls < 0.2", "calls", own="queryid = 3",
)
_finder(
    "plans", {"userid": "pid % 3", "dbid": "pid", "queryid": "slot", "planid": "slot + 1", "rows": "n", "total_time": "calls"},
    lambda f: f["query_id"].any_of([1, 2, 6]) | f["plan_id"].equals("4"), "(queryid IN (1, 2, 6) OR planid = 4)", "total_time",
)
_finder(
    "tables", {"datid": "pid % 5", "relid": KEY, "relname": NAMED, "main_fork_bytes": "calls * 1000", "toast_bytes": "CASE WHEN slot > 2 THEN n * 500 END", "seq_scan": "calls"},
    lambda f: f["table"].matches("R-*2") | f["size"].above("40kB") & f["seq_scan_rate"].above("0/s"), "(relname LIKE '%-2' OR coalesce(main_fork_bytes, 0) + coalesce(toast_bytes, 0) > 40000 AND seq_scan > 0)", "seq_scan",
)
_finder(
    "indexes", {"datid": "pid % 5", "relid": "pid", "indexrelid": KEY, "indexrelname": NAMED, "main_fork_bytes": "calls * 1024", "idx_scan": "calls"},
    lambda f: f["size"].above("30KiB") & f["index"].matches("worker"), "main_fork_bytes > 30720", "idx_scan", limit=7,
)


@query(f"""
WITH {MOMENTS}, d AS (
  SELECT *, ts - lag(ts) OVER w AS elapsed, CASE WHEN calls >= lag(calls) OVER w THEN calls - lag(calls) OVER w END AS d_calls FROM m WINDOW w AS (PARTITION BY pid, slot ORDER BY ts)),
g AS (SELECT pid, count(*) AS table_count, CASE WHEN bool_and(d_calls IS NOT NULL) THEN sum(d_calls * 1000000::DOUBLE / elapsed) END AS seq_scan, CAST(sum(n * 1000) AS BIGINT) AS main_fork_bytes
      FROM d WHERE ts BETWEEN {FOUND_AT - 200 * 86_400_000_000} AND {FOUND_AT} AND (slot IN (2, 5) OR 's' || slot LIKE '%3%') GROUP BY pid),
f AS (SELECT * FROM g WHERE main_fork_bytes > 10000 AND table_count < 12)
SELECT pid, table_count, round(seq_scan, 12) AS seq_scan, main_fork_bytes, (SELECT count(*) FROM f) AS eligible, (SELECT count(*) > 15 FROM f) AS truncated FROM f ORDER BY main_fork_bytes DESC, pid LIMIT 15
""")
def search_relation_page(spark, root):
    f = conditions.of("tables")
    wanted = (f["schema"].equals("s2") | f["schema"].equals("S5") | f["schema"].matches("3")) & (f["size"].above("10kB") & f["table_count"].below("12"))
    rows = moments(spark, root).withColumns({"schemaname": F.concat(F.lit("s"), F.col("slot")), "seq_scan": F.col("calls"), "main_fork_bytes": F.col("n") * 1000, "toast_bytes": F.lit(None).cast("long")})
    rows = relations.members(rows, ["pid", "slot"], ["seq_scan"]).where(F.col("ts").between(FOUND_AT - 200 * 86_400_000_000, FOUND_AT))
    got = relations.page(rows, "tables", ["pid"], wanted, ["seq_scan"], ["main_fork_bytes", "toast_bytes"], "main_fork_bytes", 15)
    return got.drop("toast_bytes").withColumn("seq_scan", F.round("seq_scan", 12))


@query(f"""
WITH {MOMENTS} SELECT ts, pid, slot, calls, n FROM m
WHERE (pid % 10 = 4 OR CAST(pid AS VARCHAR) IN ('7', '12')) AND (calls > 2 * 25 OR n < 2) AND calls * 10 > 251 * n
""")
def search_conditions(spark, root):
    f = {x.name: x for x in (conditions.Field("text", "text", ("label",)), conditions.Field("pid", "identifier", ("pid",)), conditions.Field("calls", "count", parts=("calls",)), conditions.Field("few", "count", parts=("n",)), conditions.Field("per", "scalar", parts=("calls", "n")))}
    wanted = (f["text"].matches("*x4y") | f["pid"].any_of([7, 12])) & (f["calls"].above("50") | f["few"].below("2")) & f["per"].above("25.1")
    rows = moments(spark, root).withColumn("label", F.concat(F.lit("X"), (F.col("pid") % 10).cast("string"), F.lit("Y")))
    return rows.where(wanted.column()).select("ts", "pid", "slot", "calls", "n")
