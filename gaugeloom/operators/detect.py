"""Findings: rows that cross fixed thresholds, and counters that rose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 4_096
# The thresholds of the detectors.
CPU_BUSY_PCT, LOAD_PER_CPU, MEMORY_LEFT_PCT, FILESYSTEM_USED_PCT = 80, 2, 10, 90
CORRUPTION = 5  # the category of log records that tell of damaged data
SLOW_MS, WRAPAROUND_AGE, HEALTH_LEAST, ACTIVE_PER_CPU = 5_000, 1_600_000_000, 50, 2

THRESHOLDS: dict[str, str] = {
    "host_cpu": f"100 * busy_delta >= {CPU_BUSY_PCT} * total_delta",
    "load": f"load1 >= {LOAD_PER_CPU} * cpus",
    "memory": f"100 * available <= {MEMORY_LEFT_PCT} * total",
    "filesystem": f"100 * (total - free) >= {FILESYSTEM_USED_PCT} * total",
    "slow_query": f"max_duration_ms >= {SLOW_MS}",
    "xid_age": f"xid_age >= {WRAPAROUND_AGE}",
    "mxid_age": f"mxid_age >= {WRAPAROUND_AGE}",
    "data_corruption": f"category = {CORRUPTION}",
    "overall_health": f"health < {HEALTH_LEAST}",
    "active_backends": f"active > {ACTIVE_PER_CPU} * cpus",
    "lock_contention": "size(blocked_by) > 0",
}


def crossing(df: DataFrame, detector: str, condition: Column | str, entity: list[str], ts: str = "ts") -> DataFrame:
    """(detector, entity, ts) of rows that meet the condition."""
    key = F.concat_ws("/", *[F.col(e).cast("string") for e in entity])
    return df.where(condition).select(F.lit(detector).alias("detector"), key.alias("entity"), F.col(ts).alias("ts"))


def crossings(df: DataFrame, detectors: list[str], entity: list[str], ts: str = "ts") -> DataFrame:
    """(detector, entity, ts) of rows that meet a threshold of any of the detectors; one pass over the rows."""
    met = F.array_compact(F.array(*[F.when(F.expr(THRESHOLDS[d]), F.lit(d)) for d in detectors]))
    return df.select(F.explode(met).alias("detector"), F.concat_ws("/", *[F.col(e).cast("string") for e in entity]).alias("entity"), F.col(ts).alias("ts"))


def risen(df: DataFrame, detector: str, counter: str, entity: list[str], ts: str = "ts") -> DataFrame:
    """Rows whose counter is above that of the row before of the same entity."""
    w = Window.partitionBy(*entity).orderBy(ts)
    return crossing(df.where(F.col(counter).isNotNull()).withColumn("_before", F.lag(counter).over(w)), detector, F.col(counter) > F.col("_before"), entity, ts)


# Counters whose rise is a finding; of several columns each may rise.
COUNTERS = {"host_oom": ("oom_kill",), "cgroup_oom": ("cgroup_oom_kill",), "archiver": ("failed_count",), "deadlocks": ("deadlocks",), "checksum": ("checksum_failures",), "sessions": ("sessions_fatal", "sessions_killed")}


def risen_counters(df: DataFrame, detectors: list[str], entity: list[str], ts: str = "ts") -> DataFrame:
    """(detector, entity, ts) of rows in which a counter of a detector is above its last known value of the same entity; one shuffle for all of them."""
    before = Window.partitionBy(*entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    met = [F.when(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > F.last(c, ignorenulls=True).over(before), F.lit(False)) for c in COUNTERS[d]]), F.lit(d)) for d in detectors]
    rows = df.withColumn("_met", F.array_compact(F.array(*met)))
    return rows.select(F.explode("_met").alias("detector"), F.concat_ws("/", *[F.col(e).cast("string") for e in entity]).alias("entity"), F.col(ts).alias("ts"))


def load(loads: DataFrame, cpus: DataFrame, entity: list[str], ts: str = "ts") -> DataFrame:
    """Moments (entity..., ts, load1, scope) of the whole host whose load is LOAD_PER_CPU or more per processor (entity..., ts, cpu_id, scope) that was online then.

    Processors are those with a row of the same time; without one, and for a load
    that is no number, there is no finding. cpu_id -1 is the sum of all. Loads
    too low for one processor go before the join, and no side is broadcast:
    Spark knows the size of neither, and a load may be one of many made of a row.
    """
    keys = [*entity, ts]
    online = cpus.where((F.col("scope") == 0) & (F.col("cpu_id") >= 0)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct("cpu_id").alias("cpus"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    high = loads.where((F.col("scope") == 0) & ~F.isnan("load1") & (F.abs("load1") < float("inf")) & (F.col("load1") >= LOAD_PER_CPU))
    held = high.hint("merge").join(online, same)
    return crossing(held, "load", THRESHOLDS["load"], entity, ts)


def events(layouts: dict[str, DataFrame], entity: list[str], ts: str = "ts") -> DataFrame:
    """Every row of the layouts that record events, by the layout's name."""
    return reduce(DataFrame.unionByName, [crossing(df, name, F.lit(True), entity, ts) for name, df in layouts.items()])


def findings(parts: list[DataFrame], cap: int = CAP) -> DataFrame:
    """All parts' distinct findings, the first `cap` in order, with their number before the cap."""
    every = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    count = every.agg(F.count(F.lit(1)).alias("found"))
    return every.orderBy("ts", "detector", "entity").limit(cap).crossJoin(F.broadcast(count))
