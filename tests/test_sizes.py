"""What grows with the input neither goes through the driver nor leaves its type: plans and sums on small frames."""

from pyspark.sql import functions as F

from gaugeloom.functions import tristate
from gaugeloom.operators import detect, links, processes, sequence, topology


def test_loads_are_joined_without_broadcast(spark):
    """A few small rows make many loads, in rows whose number Spark can't guess."""
    hosts = spark.range(1, 31).select(F.col("id").alias("host"))
    loads = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("t")).select("host", F.col("t").cast("long").alias("ts"), ((F.col("host") + F.col("t")) % 9 / 2).alias("load1"), F.lit(0).alias("scope"))
    cpus = spark.range(2_000).select((F.col("id") % 37).alias("host"), (F.col("id") % 41).alias("ts"), F.explode(F.array(F.col("id") % 5 % 3, F.lit(-1).cast("long"))).alias("cpu_id"), F.lit(0).alias("scope"))
    found = detect.load(loads, cpus, ["host"])
    got = sorted((r["entity"], r["ts"]) for r in found.collect())
    online = {}
    for k in range(2_000):
        online.setdefault((k % 37, k % 41), set()).add(k % 5 % 3)
    assert got == sorted((str(h), t) for h in range(1, 31) for t in range(40) if (h, t) in online and (h + t) % 9 / 2 >= 2 * len(online[h, t])) and len(got) > 50
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_ratios_of_sums_above_a_long(spark):
    most = 2**63 - 1
    rows = [("a", most, 2, most, 0.25), ("a", most, 2, most, 0.5), ("b", most, 1, None, 0.5), ("b", -most, None, most, None), ("b", most, 3, most, 0.5), ("b", most, 3, most, 1.5), ("c", None, None, None, None), ("d", 1, -1, 0, 1.0), ("d", 2, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x long, y int, z long, v double")
    of = lambda f, top, bottom: {r["g"]: r["r"] for r in df.groupBy("g").agg(f(F.col(top), F.col(bottom)).alias("r")).collect()}
    assert of(tristate.strict_ratio, "x", "y") == {"a": float(2 * most) / 4, "b": None, "c": None, "d": None}
    assert of(tristate.neutral_ratio, "x", "z") == {"a": 1.0, "b": None, "c": None, "d": None}
    assert of(tristate.neutral_ratio, "v", "z") == {"a": 0.75 / (2 * most), "b": None, "c": None, "d": None}
    exact = spark.createDataFrame([(1.5, "1.25"), (2.25, "2.50")], "v double, t string").agg(tristate.strict_ratio(F.col("v"), F.col("t").cast("decimal(38,10)")).alias("r")).collect()
    assert exact[0]["r"] == 1.0


def test_walks_of_links_broadcast_nothing(spark, monkeypatch):
    """Their tables pack so well that millions of rows look small."""
    plans, written = [], links.Rounds.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(links.Rounds, "written", lambda self, df: plans.append(plan(df)) or written(self, df))
    waits = spark.createDataFrame([(m, k, [k // 3, k // 2] if k < 60 else [k % 7 + 60]) for m in range(2) for k in range(1, 70)], "moment int, pid int, blocked_by array<int>")
    edges = waits.select("moment", "pid", F.element_at("blocked_by", -1).alias("up"), (F.col("pid") == 41).alias("hit"))
    one = edges.where("moment = 0")
    for df in (
        processes.lock_forest(waits, ["moment"]), processes.lock_roots(waits.where("moment = 0")), processes.with_ancestors(one, F.col("hit"), "pid", "up"), sequence.forest(one, "pid", "up", cycles=True),
        topology.layers(one, "pid", "up"), topology.charged_layers(one, one.where("pid % 5 = 0"), "pid", "up", "pid"),
    ):
        assert len(df.collect()) > 0
        plans.append(plan(df))
    assert sum("Join" in p for p in plans) > 20 and not [p for p in plans if "Broadcast" in p]
