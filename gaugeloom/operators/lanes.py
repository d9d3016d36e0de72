"""Lanes: reduced series of a host, its database and its container, as (ts, key, value).

Each lane is an aggregate per moment, or a rate between neighbouring moments;
states are not cut at segments. Rates chain the few moments, not the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeloom.functions.counters import asof, neighbours

DAY = 86_400_000_000
TICKS = ("user", "nice", "system", "irq", "softirq", "steal")


def _lane(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.select("ts", F.lit(key).alias("key"), value.cast("double").alias("value"))


def _rates(at: DataFrame, values: list[str]) -> DataFrame:
    """Per moment and value the rate since the moment before; null where it fell, is null or was null."""
    near = neighbours(at, values, "ts", DAY)
    seconds = (F.col("ts") - F.col("prev_ts")) / 1_000_000
    return near.select("ts", *[F.when(F.col(v) >= F.col(f"prev_{v}"), (F.col(v) - F.col(f"prev_{v}")).cast("double") / seconds).alias(v) for v in values])


def cpu(df: DataFrame, ticks_per_second: int = 100) -> DataFrame:
    """cpu_busy from rows (ts, cpu_id, tick counters): per cent of the moment's CPUs, row -1 being their sum."""
    cores = df.where("cpu_id >= 0").groupBy("ts").agg(F.countDistinct("cpu_id").alias("_cores"))
    busy = reduce(F.try_add, [F.col(c) for c in TICKS])
    whole = df.where("cpu_id = -1").select("ts", busy.alias("busy"))
    return _lane(_rates(whole, ["busy"]).join(cores, "ts", "left"), "cpu_busy", F.try_divide(F.col("busy") * 100, F.col("_cores") * ticks_per_second))


def stalls(df: DataFrame) -> DataFrame:
    """cpu_stall and io_stall from pressure rows (ts, scope, resource, some_us), in per cent of the time."""
    parts = [_lane(_rates(df.where((F.col("scope") == 0) & (F.col("resource") == r)).select("ts", "some_us"), ["some_us"]), key, F.col("some_us") / 10_000) for r, key in ((0, "cpu_stall"), (2, "io_stall"))]
    return reduce(DataFrame.unionByName, parts)


def disks(df: DataFrame) -> DataFrame:
    """disk_busy (no more than 100) and disk_queue from rows (ts, device, io_ms, weighted_ms), summed over devices."""
    r = _rates(df.groupBy("ts").agg(F.sum("io_ms").alias("io_ms"), F.sum("weighted_ms").alias("weighted_ms")), ["io_ms", "weighted_ms"])
    return _lane(r, "disk_busy", F.when(F.col("io_ms").isNotNull(), F.least(F.lit(100.0), F.col("io_ms") / 10))).unionByName(_lane(r, "disk_queue", F.col("weighted_ms") / 1_000))


def network(df: DataFrame) -> DataFrame:
    """net_rx, net_tx, net_drop and net_errors per second from rows of interfaces."""
    fields = {"net_rx": ["rx_bytes"], "net_tx": ["tx_bytes"], "net_drop": ["rx_drop", "tx_drop", "rx_fifo", "tx_fifo"], "net_errors": ["rx_errs", "tx_errs"]}
    at = df.groupBy("ts").agg(*[F.sum(reduce(lambda a, b: a + b, map(F.col, cols))).alias(k) for k, cols in fields.items()])
    r = _rates(at, list(fields))
    return reduce(DataFrame.unionByName, [_lane(r, k, F.col(k)) for k in fields])


def memory(df: DataFrame, vm: DataFrame) -> DataFrame:
    """memory in per cent from rows (ts, total, available); mem_swap and mem_oom per second from (ts, pswpin, pswpout, oom_kill)."""
    used = _lane(df, "memory", F.try_divide((F.col("total") - F.col("available")).cast("double") * 100, F.col("total")))
    r = _rates(vm.select("ts", (F.col("pswpin") + F.col("pswpout")).alias("swap"), "oom_kill"), ["swap", "oom_kill"])
    return reduce(DataFrame.unionByName, [used, _lane(r, "mem_swap", F.col("swap")), _lane(r, "mem_oom", F.col("oom_kill"))])


def backends(df: DataFrame) -> DataFrame:
    """pg_running, pg_waiting, pg_lock_waiting and pg_oldest_xact from rows of sessions."""
    client = (F.col("state") == "active") & (F.col("backend_type") == "client backend") & F.col("leader_pid").isNull()
    at = df.groupBy("ts").agg(
        F.count_if(client & F.col("wait_event_type").isNull()).alias("pg_running"), F.count_if(client & F.col("wait_event_type").isNotNull()).alias("pg_waiting"),
        F.count_if(F.col("wait_event_type") == "Lock").alias("pg_lock_waiting"),
        F.max(F.when(F.col("xact_start").isNotNull(), F.greatest(F.lit(0), F.col("ts") - F.col("xact_start")) / 1_000_000)).alias("pg_oldest_xact"),
    )
    return reduce(DataFrame.unionByName, [_lane(at, k, F.col(k)) for k in ("pg_running", "pg_waiting", "pg_lock_waiting", "pg_oldest_xact")])


def container(df: DataFrame, capacity: DataFrame, path: str) -> DataFrame:
    """cg_* lanes of one control group: rows (ts, path, usage_us, throttled_us, cpu_psi_us, mem_psi_us, io_psi_us, rbytes, wbytes, oom_kill, memory, limit, pids, pids_max).

    The share of CPU is of the capacity (ts, cpus) at or before the row's time.
    """
    own = df.where(F.col("path") == path)
    r = _rates(own.select("ts", "usage_us", "throttled_us", "cpu_psi_us", "mem_psi_us", "io_psi_us", "rbytes", "wbytes", "oom_kill"), ["usage_us", "throttled_us", "cpu_psi_us", "mem_psi_us", "io_psi_us", "rbytes", "wbytes", "oom_kill"])
    r = asof(r, capacity, [], ["cpus"], width=DAY).drop("asof_ts")
    cores = F.col("usage_us") / 1_000_000
    rated = {
        "cg_cpu_cores": cores, "cg_cpu_share": F.try_divide(cores * 100, F.col("cpus")), "cg_cpu_throttle": F.col("throttled_us") / 10_000, "cg_cpu_psi": F.col("cpu_psi_us") / 10_000, "cg_mem_psi": F.col("mem_psi_us") / 10_000,
        "cg_io_psi": F.col("io_psi_us") / 10_000, "cg_io_read": F.col("rbytes"), "cg_io_write": F.col("wbytes"), "cg_oom": F.col("oom_kill"),
    }
    held = {"cg_memory": F.try_divide(F.col("memory").cast("double") * 100, F.col("limit")), "cg_memory_bytes": F.col("memory"), "cg_pids": F.col("pids"), "cg_pids_share": F.try_divide(F.col("pids").cast("double") * 100, F.col("pids_max"))}
    return reduce(DataFrame.unionByName, [*(_lane(r, k, v) for k, v in rated.items()), *(_lane(own, k, v) for k, v in held.items())])


def merged(parts: list[DataFrame]) -> DataFrame:
    """All lanes by time and key."""
    return reduce(DataFrame.unionByName, parts).orderBy("ts", "key")


def first_known(lanes: DataFrame, cells: dict[str, list[str]]) -> DataFrame:
    """(ts, cell, value): of each cell's lanes in order the first with a value."""
    keys = sorted({k for ks in cells.values() for k in ks})
    wide = lanes.groupBy("ts").pivot("key", keys).agg(F.max("value"))
    return wide.select("ts", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.coalesce(*[F.col(k) for k in ks]).alias("value")) for c, ks in cells.items()])).alias("x")).select("ts", "x.cell", "x.value")


def tone(value: Column, warn: float, bad: float) -> Column:
    """Whether a value is fine, worth a look, or bad; null stays null."""
    return F.when(value >= bad, "bad").when(value >= warn, "warn").when(value.isNotNull(), "fine")
