"""Derived metrics of database statistics. d[...] is the change of a counter, g[...] the value of a gauge.

A ratio is null for a null operand or a zero divisor. Outputs named *_pct are
per cent, others are plain quotients.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return quotient(top, bottom) * 100


def neutral_sum(*values: Column) -> Column:
    """The sum of the operands that are known; null if none is."""
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values[1:]), F.coalesce(values[0], F.lit(0))))


Get = Callable[[str], Column]

POOLS = ("heap", "idx", "toast", "tidx")
STATEMENT: dict[str, Callable[[Get, Get], Column]] = {
    "mean_exec_ms_per_call": lambda d, g: quotient(d("total_exec_time"), d("calls")),
    "rows_per_call": lambda d, g: quotient(d("rows"), d("calls")),
    "blocks_per_call": lambda d, g: quotient(d("shared_blks_hit") + d("shared_blks_read") + d("local_blks_hit") + d("local_blks_read"), d("calls")),
    "hit_fraction": lambda d, g: quotient(d("shared_blks_hit"), d("shared_blks_hit") + d("shared_blks_read")),
    "wal_per_call": lambda d, g: quotient(d("wal_bytes"), d("calls")),
    "plan_time_fraction": lambda d, g: quotient(d("total_plan_time"), d("total_plan_time") + d("total_exec_time")),
    "cv": lambda d, g: quotient(g("stddev_exec_time"), g("mean_exec_time")),
}

TABLE: dict[str, Callable[[Get, Get], Column]] = {
    "dead_pct": lambda d, g: percent(g("n_dead_tup"), g("n_live_tup") + g("n_dead_tup")),
    "hot_pct": lambda d, g: percent(d("n_tup_hot_upd"), d("n_tup_upd")),
    "new_page_pct": lambda d, g: percent(d("n_tup_newpage_upd"), d("n_tup_upd")),
    "sequential_share_pct": lambda d, g: percent(neutral_sum(d("seq_scan")), neutral_sum(d("seq_scan"), d("idx_scan"))),
    "seq_tuples_per_scan": lambda d, g: quotient(d("seq_tup_read"), d("seq_scan")),
    "idx_tuples_per_scan": lambda d, g: quotient(d("idx_tup_fetch"), d("idx_scan")),
    "insert_share_pct": lambda d, g: percent(d("n_tup_ins"), d("n_tup_ins") + d("n_tup_upd") + d("n_tup_del")),
    "update_share_pct": lambda d, g: percent(d("n_tup_upd"), d("n_tup_ins") + d("n_tup_upd") + d("n_tup_del")),
    "delete_share_pct": lambda d, g: percent(d("n_tup_del"), d("n_tup_ins") + d("n_tup_upd") + d("n_tup_del")),
    "heap_buffer_hit_pct": lambda d, g: percent(d("heap_blks_hit"), d("heap_blks_read") + d("heap_blks_hit")),
    "index_buffer_hit_pct": lambda d, g: percent(d("idx_blks_hit"), d("idx_blks_read") + d("idx_blks_hit")),
    "toast_buffer_hit_pct": lambda d, g: percent(d("toast_blks_hit"), d("toast_blks_read") + d("toast_blks_hit")),
    "tidx_buffer_hit_pct": lambda d, g: percent(d("tidx_blks_hit"), d("tidx_blks_read") + d("tidx_blks_hit")),
    "buffer_hit_pct": lambda d, g: percent(neutral_sum(*[d(f"{p}_blks_hit") for p in POOLS]), neutral_sum(*[d(f"{p}_blks_{x}") for p in POOLS for x in ("read", "hit")])),
    "displayed_storage_bytes": lambda d, g: neutral_sum(g("main_bytes"), g("toast_bytes")),
    "toast_dead_pct": lambda d, g: percent(g("toast_n_dead_tup"), g("toast_n_live_tup") + g("toast_n_dead_tup")),
    "toast_share_pct": lambda d, g: percent(g("toast_bytes"), g("main_bytes") + g("toast_bytes")),
    "vacuum_mean_ms": lambda d, g: quotient(d("total_vacuum_time"), d("vacuum_count")),
    "autovacuum_mean_ms": lambda d, g: quotient(d("total_autovacuum_time"), d("autovacuum_count")),
    "autoanalyze_mean_ms": lambda d, g: quotient(d("total_autoanalyze_time"), d("autoanalyze_count")),
    "analyze_mean_ms": lambda d, g: quotient(d("total_analyze_time"), d("analyze_count")),
}

INDEX: dict[str, Callable[[Get, Get], Column]] = {
    "tuples_per_scan": lambda d, g: quotient(d("idx_tup_read"), d("idx_scan")),
    "fetches_per_scan": lambda d, g: quotient(d("idx_tup_fetch"), d("idx_scan")),
    "buffer_hit_pct": lambda d, g: percent(d("idx_blks_hit"), d("idx_blks_read") + d("idx_blks_hit")),
    "no_scans": lambda d, g: d("idx_scan") == 0,
}


#: Sums of rates, r_*; reads that a layout lacks add nothing, writes are all required.
RATES: dict[str, Callable[[Get, Get], Column]] = {
    "tuple_throughput": lambda r, g: neutral_sum(r("seq_tup_read"), r("idx_tup_fetch")),
    "dml_total": lambda r, g: r("n_tup_ins") + r("n_tup_upd") + r("n_tup_del"),
}


def scan_counts(change: str = "d_idx_scan") -> list[Column]:
    """Of a group of indexes those without a scan, and those whose scans are known."""
    return [F.count_if(F.col(change) == 0).alias("no_scan_count"), F.count(change).alias("known_scan_count")]


def derived(metrics: dict[str, Callable[[Get, Get], Column]], columns: set[str], change: str = "d_") -> list[Column]:
    """Those metrics whose operands are all there, as `d_*` (or another prefix) for changes and by name for gauges."""
    out = []
    for name, formula in metrics.items():
        used: set[str] = set()

        def note(prefix: str, used: set[str] = used) -> Get:
            return lambda c: (used.add(prefix + c), F.col(prefix + c))[1]

        column = formula(note(change), note(""))
        if used <= columns:
            out.append(column.alias(name))
    return out


def cpu_capacity(quota: Column, period: Column, cpus: Column) -> Column:
    """CPUs that a group may use: all of its set without a quota, else no more than quota / period."""
    return F.when(quota == -1, cpus.cast("double")).when((quota > 0) & (period > 0) & cpus.isNotNull(), F.least(quota / period, cpus.cast("double")))
