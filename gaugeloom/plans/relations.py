"""Grouped relation statistics: orders as members, their customers' nations and regions as schemas and databases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeloom.functions import tristate
from gaugeloom.functions.timeutil import HOUR, ts_us
from gaugeloom.operators import relations
from gaugeloom.plans.registry import REC, gauges, query
from gaugeloom.sources.tables import table

#: Changes of a customer's order totals, in cents; unknown where they fell or are the first.
FACTS = """f AS (
  SELECT o_orderkey, o_custkey AS object, n_nationkey AS schema_id, n_regionkey AS datid, o_orderpriority AS tablespace, epoch_us(o_orderdate) AS ts,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
d AS (
  SELECT *, ts - lag(ts) OVER w AS elapsed, CASE WHEN cents >= lag(cents) OVER w THEN cents - lag(cents) OVER w END AS d_cents FROM f
  WINDOW w AS (PARTITION BY object ORDER BY ts, o_orderkey))"""


def facts(spark, root):
    o, c, n = (table(spark, root, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "o_orderkey", F.col("o_custkey").alias("object"), F.col("n_nationkey").alias("schema_id"), F.col("n_regionkey").alias("datid"), F.col("o_orderpriority").alias("tablespace"),
        ts_us("o_orderdate").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def changes(spark, root):
    w = Window.partitionBy("object").orderBy("ts", "o_orderkey")
    f = facts(spark, root)
    return f.withColumn("elapsed", F.col("ts") - F.lag("ts").over(w)).withColumn("d_cents", F.when(F.col("cents") >= F.lag("cents").over(w), F.col("cents") - F.lag("cents").over(w)))


def _register(level: str, key: str):
    sql = f"""
WITH {FACTS}
SELECT {key}, count(*) AS members, CASE WHEN NOT bool_or(d_cents IS NULL) THEN CAST(sum(d_cents) AS BIGINT) END AS d_cents, max(cents) AS cents FROM d WHERE {key} IS NOT NULL GROUP BY 1"""

    def run(spark, root):
        return relations.grouped(changes(spark, root), [key], ["d_cents"], ["cents"])

    run.__name__ = f"relation_group_{level}"
    query(sql)(run)


for _level, _key in (("database", "datid"), ("schema", "schema_id"), ("object", "object"), ("tablespace", "tablespace")):
    _register(_level, _key)


@query(f"""
WITH {FACTS}, m AS (SELECT *, d_cents IS NULL AND o_orderkey % 5 = 0 AS unavailable FROM d)
SELECT schema_id, CASE WHEN NOT bool_or(unavailable) THEN CAST(sum(d_cents) AS BIGINT) END AS total FROM m GROUP BY 1
""")
def tristate_sum(spark, root):
    m = changes(spark, root).withColumn("unavailable", F.col("d_cents").isNull() & (F.col("o_orderkey") % 5 == 0))
    return m.groupBy("schema_id").agg(tristate.total(F.col("d_cents"), F.col("unavailable")).alias("total"))


@query(f"""
WITH {FACTS}
SELECT tablespace, CASE WHEN NOT bool_or(d_cents IS NULL) THEN CAST(sum(d_cents) AS DOUBLE) / nullif(sum(elapsed), 0) END AS strict,
       CASE WHEN NOT bool_or((d_cents IS NULL) <> (x IS NULL)) THEN CAST(sum(d_cents) AS DOUBLE) / nullif(CAST(sum(x) AS DOUBLE), 0) END AS neutral
FROM (SELECT *, CASE WHEN d_cents IS NOT NULL THEN cents END AS x FROM d) GROUP BY 1
""")
def neutral_ratio(spark, root):
    d = changes(spark, root).withColumn("x", F.when(F.col("d_cents").isNotNull(), F.col("cents")))
    return d.groupBy("tablespace").agg(tristate.strict_ratio(F.col("d_cents"), F.col("elapsed")).alias("strict"), tristate.neutral_ratio(F.col("d_cents"), F.col("x")).alias("neutral"))


@query(f"""
WITH {FACTS}, v AS (SELECT schema_id, CASE WHEN o_orderkey % 4 <> 0 THEN ts END AS last_vacuum FROM d)
SELECT schema_id, min(last_vacuum) AS oldest, max(last_vacuum) AS latest, count(*) FILTER (last_vacuum IS NULL) AS never_count FROM v GROUP BY 1
""")
def timestamp_never(spark, root):
    v = facts(spark, root).withColumn("last_vacuum", F.when(F.col("o_orderkey") % 4 != 0, F.col("ts")))
    return v.groupBy("schema_id").agg(*tristate.oldest_latest_never(F.col("last_vacuum")))


@query(f"""
WITH {FACTS}, e AS (SELECT datid, elapsed, sum(d_cents) AS s FROM d WHERE d_cents IS NOT NULL AND elapsed > 0 GROUP BY 1, 2)
SELECT datid, round(sum(CAST(s AS DOUBLE) * 1000000 / elapsed), 6) AS rate FROM e GROUP BY 1
""")
def relation_rate_sum(spark, root):
    return relations.rate_sums(changes(spark, root), ["datid"], "d_cents").withColumn("rate", F.round("rate", 6))


@query(f"""
WITH {FACTS}, v AS (SELECT schema_id, o_orderkey % 97 <> 0 AS valid, o_orderkey % 11 <> 0 AS ready FROM d)
SELECT schema_id, max(CASE WHEN NOT valid THEN 2 WHEN NOT ready THEN 1 ELSE 0 END) AS severity, count(*) FILTER (valid) AS valid_count, count(*) FILTER (ready) AS ready_count FROM v GROUP BY 1
""")
def state_severity(spark, root):
    v = facts(spark, root).select("schema_id", (F.col("o_orderkey") % 97 != 0).alias("valid"), (F.col("o_orderkey") % 11 != 0).alias("ready"))
    return relations.severities(v, ["schema_id"], "valid", "ready")


@query("""
SELECT event_type, CAST(sum(user_id) FILTER (b IS NOT NULL) AS BIGINT) AS top, CAST(sum(b) AS BIGINT) AS bottom
FROM (SELECT event_type, user_id, CASE WHEN event_id % 3 <> 0 THEN event_id END AS b FROM events) GROUP BY 1
""")
def paired_sums(spark, root):
    e = table(spark, root, "events").select("event_type", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("b"))
    return e.groupBy("event_type").agg(tristate.paired(F.col("user_id"), F.col("b")).alias("top"), tristate.paired(F.col("b"), F.col("user_id")).alias("bottom"))


@query(f"""
WITH {REC}, s AS (SELECT ts, event_type, cents, cents - coalesce(lag(cents) OVER w, 0) AS step, CASE WHEN lag(cents) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM rec WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT ts, sum(step) AS step, sum(new) AS new FROM s GROUP BY 1)
SELECT ts, CAST(sum(new) OVER (ORDER BY ts) AS BIGINT) AS parts, CAST(sum(step) OVER (ORDER BY ts) AS BIGINT) AS cents FROM g
""")
def latest_merge(spark, root):
    return relations.latest_of_each(gauges(spark, root), "event_type", ["cents"])


@query(f"""
WITH {REC}, m AS (SELECT DISTINCT event_type, ts // {HOUR} * {HOUR} AS ts FROM rec), v AS (SELECT event_type, ts // {HOUR} * {HOUR} AS ts, sum(cents) AS cents FROM rec WHERE event_id % 3 > 0 GROUP BY 1, 2),
s AS (SELECT m.*, v.cents IS NOT NULL AS live, coalesce(v.cents, 0) AS cents FROM m LEFT JOIN v USING (event_type, ts)),
d AS (SELECT ts, live::INTEGER - coalesce(lag(live) OVER w, false)::INTEGER AS new, cents - coalesce(lag(cents) OVER w, 0) AS step FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT ts, sum(new) AS new, sum(step) AS step FROM d GROUP BY 1), o AS (SELECT ts, CAST(sum(new) OVER (ORDER BY ts) AS BIGINT) AS parts, CAST(sum(step) OVER (ORDER BY ts) AS BIGINT) AS cents FROM g)
SELECT * FROM o WHERE parts > 0
""")
def latest_merge_removed(spark, root):
    hour = (F.floor(F.col("ts") / HOUR) * HOUR).cast("long").alias("ts")
    e = gauges(spark, root)
    rows = e.where("event_id % 3 > 0").groupBy("event_type", hour).agg(F.sum("cents").alias("cents"))
    return relations.latest_of_each(rows, "event_type", ["cents"], moments=e.select("event_type", hour))


HISTORY = (883_612_800_000_000, 946_684_800_000_000)  # 1998 and 1999


@query(f"""
WITH f AS (SELECT epoch_us(date_trunc('month', l_shipdate)) AS ts, l_suppkey AS object, CAST(l_suppkey % 5 AS BIGINT) AS datid, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls FROM lineitem GROUP BY ALL),
c AS (SELECT *, lag(ts) OVER (PARTITION BY datid ORDER BY ts) AS past FROM (SELECT DISTINCT datid, ts FROM f WHERE ts <= {HISTORY[1]}))
SELECT f.ts, f.datid, count(*) AS members, CAST(sum(CASE WHEN f.calls >= p.calls THEN f.calls - p.calls END) AS BIGINT) AS d_calls
FROM f JOIN c ON f.datid = c.datid AND f.ts = c.ts LEFT JOIN f p ON p.datid = f.datid AND p.object = f.object AND p.ts = c.past
WHERE f.ts BETWEEN {HISTORY[0]} AND {HISTORY[1]} GROUP BY ALL
""")
def relation_history(spark, root):
    return relations.history(monthly(spark, root), "datid", ["datid"], ["object"], ["calls"], *HISTORY)


def monthly(spark, root):
    """Suppliers' quantities by month as relations with a counter, in five databases."""
    li = table(spark, root, "lineitem")
    return li.groupBy(ts_us(F.date_trunc("month", F.col("l_shipdate"))).alias("ts"), F.col("l_suppkey").alias("object")).agg(F.sum(F.col("l_quantity").cast("long")).alias("calls")).withColumn("datid", F.col("object") % 5)


@query(f"""
WITH f AS (SELECT epoch_us(date_trunc('month', l_shipdate)) AS ts, l_suppkey AS object, CAST(l_suppkey % 5 AS BIGINT) AS datid, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS calls FROM lineitem GROUP BY ALL),
k AS (SELECT *, (object + ts // 86400000000) % 19 < 5 AND NOT (datid = 2 AND ts // 86400000000 % 2 = 0) AS chosen FROM f WHERE ts <= {HISTORY[1]}),
c AS (SELECT *, lag(ts) OVER (PARTITION BY datid ORDER BY ts) AS past FROM (SELECT DISTINCT datid, ts FROM k)),
h AS (SELECT k.ts, k.datid, count(*) AS members, sum(CASE WHEN k.calls >= p.calls THEN k.calls - p.calls END) AS d_calls FROM k JOIN c ON k.datid = c.datid AND k.ts = c.ts LEFT JOIN k p ON p.datid = k.datid AND p.object = k.object AND p.ts = c.past WHERE k.chosen GROUP BY ALL),
t AS (SELECT DISTINCT ts FROM c WHERE ts BETWEEN {HISTORY[0]} AND {HISTORY[1]}),
n AS (SELECT t.ts, c.datid, max(c.ts) AS at FROM t JOIN c ON c.ts <= t.ts GROUP BY ALL)
SELECT n.ts, count(*) AS parts, CAST(sum(h.members) AS BIGINT) AS members, CASE WHEN bool_and(h.d_calls IS NOT NULL) THEN CAST(sum(h.d_calls) AS BIGINT) END AS d_calls FROM n JOIN h ON h.datid = n.datid AND h.ts = n.at GROUP BY n.ts
""")
def relation_history_tablespace(spark, root):
    day = F.floor(F.col("ts") / 86_400_000_000)
    chosen = ((F.col("object") + day) % 19 < 5) & ~((F.col("datid") == 2) & (day % 2 == 0))
    return relations.tablespace_history(monthly(spark, root), "datid", chosen, ["object"], ["calls"], *HISTORY)
