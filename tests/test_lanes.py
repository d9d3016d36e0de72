"""Lanes, process tables, lock forests and maintenance episodes on small frames."""

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import lanes, processes

S = 1_000_000


def by_key(df):
    return {(r["ts"] // S, r["key"]): r["value"] for r in df.collect()}


def test_cpu_and_stalls(spark):
    ticks = [(t * S, c, *([t * 10] * 6)) for t in (1, 2, 4) for c in (-1, 0, 1)]
    got = by_key(lanes.cpu(spark.createDataFrame(ticks, "ts long, cpu_id int, user long, nice long, system long, irq long, softirq long, steal long")))
    assert got == {(1, "cpu_busy"): None, (2, "cpu_busy"): 30.0, (4, "cpu_busy"): 30.0}
    psi = spark.createDataFrame([(S, 0, 0, 0), (2 * S, 0, 0, 250_000), (S, 0, 2, 9), (2 * S, 0, 2, 3), (2 * S, 1, 0, 7)], "ts long, scope int, resource int, some_us long")
    assert by_key(lanes.stalls(psi)) == {(1, "cpu_stall"): None, (2, "cpu_stall"): 25.0, (1, "io_stall"): None, (2, "io_stall"): None}


def test_disk_network_and_memory(spark):
    d = spark.createDataFrame([(S, "a", 0, 0), (S, "b", 0, 0), (2 * S, "a", 900, 500), (2 * S, "b", 600, 500)], "ts long, device string, io_ms long, weighted_ms long")
    assert by_key(lanes.disks(d))[2, "disk_busy"] == 100.0 and by_key(lanes.disks(d))[2, "disk_queue"] == 1.0
    n = spark.createDataFrame([(S, *[0] * 8), (3 * S, 10, 20, 1, 2, 3, 4, 5, 6)], "ts long, rx_bytes long, tx_bytes long, rx_drop long, tx_drop long, rx_fifo long, tx_fifo long, rx_errs long, tx_errs long")
    got = by_key(lanes.network(n))
    assert [got[3, k] for k in ("net_rx", "net_tx", "net_drop", "net_errors")] == [5.0, 10.0, 5.0, 5.5]
    m = spark.createDataFrame([(S, 100, 25), (2 * S, 0, 0)], "ts long, total long, available long")
    vm = spark.createDataFrame([(S, 1, 1, None), (2 * S, 3, 5, 4)], "ts long, pswpin long, pswpout long, oom_kill long")
    got = by_key(lanes.memory(m, vm))
    assert got[1, "memory"] == 75.0 and got[2, "memory"] is None and got[2, "mem_swap"] == 6.0 and got[2, "mem_oom"] is None


def test_backends_and_container(spark):
    rows = [(S, "active", "client backend", None, None, 0), (S, "active", "client backend", None, "Lock", None), (S, "active", "client backend", 5, None, 2 * S), (S, "idle", "walwriter", None, "Lock", None)]
    got = by_key(lanes.backends(spark.createDataFrame(rows, "ts long, state string, backend_type string, leader_pid int, wait_event_type string, xact_start long")))
    assert [got[1, k] for k in ("pg_running", "pg_waiting", "pg_lock_waiting", "pg_oldest_xact")] == [1.0, 1.0, 2.0, 1.0]
    names = "ts long, path string, usage_us long, throttled_us long, cpu_psi_us long, mem_psi_us long, io_psi_us long, rbytes long, wbytes long, oom_kill long, memory long, limit long, pids long, pids_max long"
    rows = [(S, "/a", *[0] * 8, 50, 200, 3, None), (2 * S, "/a", 500_000, 0, 0, 0, 0, 7, 0, 1, 60, 200, 3, 30), (2 * S, "/b", *[9] * 8, 1, 1, 1, 1)]
    got = by_key(lanes.container(spark.createDataFrame(rows, names), spark.createDataFrame([(0, 2.0)], "ts long, cpus double"), "/a"))
    assert (got[2, "cg_cpu_cores"], got[2, "cg_cpu_share"], got[2, "cg_io_read"], got[2, "cg_memory"], got[1, "cg_pids_share"], got[2, "cg_oom"]) == (0.5, 25.0, 7.0, 30.0, None, 1.0)


def test_cells_fall_back_and_have_tones(spark):
    df = spark.createDataFrame([(1, "cg_cpu_share", None), (1, "cpu_busy", 91.0), (2, "cg_cpu_share", 5.0), (2, "cpu_busy", 1.0)], "ts long, key string, value double")
    got = {r["ts"]: (r["value"], r["t"]) for r in lanes.first_known(df, {"cpu": ["cg_cpu_share", "cpu_busy"]}).select("ts", "value", lanes.tone(F.col("value"), 70, 90).alias("t")).collect()}
    assert got == {1: (91.0, "bad"), 2: (5.0, "fine")}


def test_lock_roots_with_cycles(spark):
    waits = spark.createDataFrame([(10, [5, 7]), (11, [10]), (20, [21]), (21, [22]), (22, [20]), (23, [22]), (30, [0]), (40, [])], "pid int, blocked_by array<int>")
    got = {r["pid"]: (r["root"], r["level"]) for r in processes.lock_roots(waits).collect()}
    assert got == {5: (5, 0), 10: (5, 1), 11: (5, 2), 20: (20, 0), 21: (20, 2), 22: (20, 1), 23: (20, 2), 0: (0, 0), 30: (0, 1)}


def test_long_chains_of_waits_and_ancestors(spark):
    """150 waiters in a row, and one of a smaller pid that waits for a cycle."""
    rows = [*((k, [k - 1]) for k in range(101, 251)), (520, [521]), (521, [520]), (7, [521]), (30, [30])]
    got = {r["pid"]: (r["root"], r["level"]) for r in processes.lock_roots(spark.createDataFrame(rows, "pid int, blocked_by array<int>")).collect()}
    assert got == {**{k: (100, k - 100) for k in range(100, 251)}, 520: (520, 0), 521: (520, 1), 7: (520, 2), 30: (30, 0)}
    tree = spark.createDataFrame([*((k, k - 1, k == 250) for k in range(101, 251)), (100, None, False), (99, 100, False), (500, 501, True), (501, 500, False), (502, 501, None)], "pid int, ppid int, hit boolean")
    assert sorted(r["pid"] for r in processes.with_ancestors(tree, F.col("hit"), "pid", "ppid").collect()) == [*range(100, 251), 500, 501]
    several = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 4, False), (3, 5, False), (5, None, False), (4, None, False), (6, None, False)], "pid int, ppid int, hit boolean")
    assert sorted({r["pid"] for r in processes.with_ancestors(several, F.col("hit"), "pid", "ppid").collect()}) == [1, 2, 3, 4, 5]


def test_names_scopes_and_ancestors(spark):
    users = spark.createDataFrame([(1, 7, "old"), (2, 7, "new"), (1, 8, "x")], "ts long, uid long, user string")
    got = {r["pid"]: r["user"] for r in processes.with_users(spark.createDataFrame([(1, 7), (2, 9)], "pid int, uid long"), users).collect()}
    assert got == {1: "new", 2: None}
    s = spark.createDataFrame([(1, "/* own */ select"), (2, "select"), (0, "/* own */ x"), (3, None)], "queryid long, query string")
    kept, plans = processes.without_scope(s, spark.createDataFrame([(1,), (2,), (0,)], "queryid long"), "/* own */", ["queryid"])
    assert sorted(r["queryid"] for r in kept.collect()) == [2, 3] and sorted(r["queryid"] for r in plans.collect()) == [0, 2]
    tree = spark.createDataFrame([(1, None, "init"), (2, 1, "a"), (3, 2, "hit"), (4, 1, "b")], "pid int, ppid int, comm string")
    assert sorted(r["pid"] for r in processes.with_ancestors(tree, F.col("comm") == "hit", "pid", "ppid").collect()) == [1, 2, 3]
    big = spark.createDataFrame([(2**63 - 1, 1), (1, 2)], "utime long, stime long")
    assert [r["cpu_time_ticks"] for r in processes.cpu_time(big).collect()] == [None, 3]


@pytest.mark.parametrize(("tail", "stuck"), [([5, 5, 5], True), ([5, 5, 6], False)])
def test_vacuum_episodes(spark, tail, stuck):
    df = spark.createDataFrame([(1, t * 10, v) for t, v in enumerate([0, 2, 4, *tail])], "pid int, ts long, v long")
    got = processes.vacuum_episodes(df, ["pid"], 10, "v").collect()
    assert [(r["samples"], r["done"], r["stuck"]) for r in got] == [(6, max(tail), stuck)]
