"""Processes, sessions and locks: names, derived columns, forests, episodes of maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions.counters import asof
from gaugeloom.operators import links
from gaugeloom.operators.sequence import episodes

USERS = 4_096


def with_users(df: DataFrame, users: DataFrame, uid: str = "uid", scope: str | None = None, ts: str = "ts") -> DataFrame:
    """df with `user`: the latest name of each user number. No more than USERS of the latest numbers are looked up, so the table is broadcast."""
    keys = [uid] if scope is None else [scope, uid]
    latest = users.groupBy(*keys).agg(F.max_by("user", ts).alias("user"), F.max(ts).alias("_t")).orderBy(F.desc("_t"), *keys).limit(USERS).drop("_t")
    return df.join(F.broadcast(latest), keys, "left")


def cpu_time(df: DataFrame) -> DataFrame:
    """df with cpu_time_ticks, null if the sum does not fit."""
    return df.withColumn("cpu_time_ticks", F.try_add("utime", "stime"))


def without_scope(statements: DataFrame, plans: DataFrame, prefix: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Statements whose text does not begin with `prefix`, and plans of no statement that does; query 0 names no statement."""
    own = F.coalesce(F.col("query").startswith(prefix), F.lit(False))
    out = statements.where(own & (F.col("queryid") != 0)).select(*key).distinct()
    return statements.where(~own), plans.join(out, key, "left_anti")


def activity_age(df: DataFrame, start: str, states: list[str], ts: str = "ts") -> Column:
    """Seconds since a start, in given states only; null for starts that are unset or ahead."""
    age = F.col(ts) - F.col(start)
    return F.when(F.col("state").isin(states) & (F.col(start) > 0) & (age >= 0), age / 1_000_000)


def lock_roots(waits: DataFrame) -> DataFrame:
    """(pid, root, level) of a moment's lock waits (pid, blocked_by): who waits, in the end, for whom.

    A waiter hangs below its smallest blocker; prepared transactions are blocker
    0. Holders that wait for nobody are roots; in a cycle the smallest pid is
    one, also of those that wait for the cycle. Chains may be of any length.
    """
    edges = waits.where(F.size("blocked_by") > 0).groupBy("pid").agg(F.min(F.array_min("blocked_by")).alias("up"))
    nodes = edges.select("pid").union(edges.select("up")).where("pid IS NOT NULL").distinct()
    return links.roots(links.joined(nodes, edges, "pid", "left").select(F.col("pid").alias("node"), "up")).withColumnRenamed("node", "pid")


def lock_forest(waits: DataFrame, by: list[str], pid: str = "pid", blocked_by: str = "blocked_by") -> DataFrame:
    """(by..., pid, component, tree, depth, parent, extra_blockers, waits_on_prepared, path): who waits for whom, per `by`, as a moment.

    A waiter keeps all its blockers: it hangs below the one through which a walk
    from the roots, the smaller pid first, meets it, and the others are
    extra_blockers. Blocker 0 is a prepared transaction, which has no row; other
    blockers without a row are left out. Chains that share a session are one
    component, named by its lowest pid. What no session without blockers
    reaches, as a cycle, is walked from its lowest pid on, in a further tree.
    Rows ordered by `by`, component and path stand as the walk meets them, and
    components don't interleave. Rows without a pid are left out; rows of one
    pid count as one. In parts with cycles the first way that passes no session
    twice counts.
    """
    rounds = links.Rounds(waits.sparkSession)
    node = lambda name: F.struct(*by, F.col(name).cast("long").alias("pid"))
    listed = waits.where(F.col(pid).isNotNull()).select(node(pid).alias("node"), F.coalesce(F.col(blocked_by).cast("array<long>"), F.array().cast("array<long>")).alias("_b"))
    rows = rounds.written(listed.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_b")))).alias("_b")))  # a session's own rows
    blocked = rows.select("node", F.explode("_b").alias("_up")).where("_up <> 0").withColumn("up", F.struct(*[F.col(f"node.{b}").alias(b) for b in by], F.col("_up").alias("pid")))
    steps = rounds.written(links.joined(blocked, rows.select(F.col("node").alias("up")), "up", "left_semi").select("up", "node", F.col("node.pid").alias("name")))
    label = links.components(steps.select(F.col("up").alias("a"), F.col("node").alias("b")), rounds)
    nodes = rounds.written(links.joined(rows.select("node"), label, "node", "left").select("node", F.coalesce("label.pid", "node.pid").alias("component")))

    path = lambda tree: F.array(F.lit(tree).cast("long"), F.col("node.pid")).alias("path")
    met = links.first_paths(links.joined(nodes, steps, "node", "left_anti").select("node", path(0)), steps, rounds)
    left, tree = rounds.written(links.joined(nodes, met, "node", "left_anti")), 0
    while not left.isEmpty():
        tree += 1
        starts = left.groupBy("component", *[F.col(f"node.{b}").alias(b) for b in by]).agg(F.min("node").alias("node")).select("node", path(tree))
        rest = links.joined(links.joined(steps, left.select("node"), "node", "left_semi"), left.select(F.col("node").alias("up")), "up", "left_semi")
        met = rounds.written(met.unionByName(links.first_paths(starts, rest, rounds)))
        left = rounds.written(links.joined(left, met, "node", "left_anti"))
    depth = F.size("path") - 1
    parent = F.when(depth > 1, F.element_at("path", -2))
    present = steps.groupBy("node").agg(F.array_sort(F.collect_list("up.pid")).alias("_present"))
    out = links.joined(links.joined(links.joined(rows, nodes, "node"), met, "node"), present, "node", "left")
    return out.select(
        *[F.col(f"node.{b}").alias(b) for b in by], F.col("node.pid").alias("pid"), "component", F.element_at("path", 1).cast("int").alias("tree"), depth.alias("depth"), parent.alias("parent"),
        F.coalesce(F.filter("_present", lambda b: ~b.eqNullSafe(parent)), F.array().cast("array<long>")).alias("extra_blockers"), F.array_contains("_b", F.lit(0).cast("long")).alias("waits_on_prepared"), F.slice("path", 2, depth).alias("path"),
    )


def with_ancestors(df: DataFrame, matches: Column, child: str, parent: str) -> DataFrame:
    """Rows that match and all their ancestors, however far; cycles end where they began."""
    edges = df.select(F.col(child).alias("node"), F.col(parent).alias("up"), F.coalesce(matches, F.lit(False)).alias("_m"))
    kept = links.upward(edges, edges.where("_m")).withColumnRenamed("node", "_kept")
    return links.joined(df, kept, F.col(child) == F.col("_kept"), "left_semi")


def vacuum_episodes(df: DataFrame, by: list[str], interval: int, progress: str, ts: str = "ts") -> DataFrame:
    """A row per episode: its time, samples, progress, and whether the last three samples or more did not move."""
    rows = episodes(df, by, interval, [progress], ts)
    back = Window.partitionBy(*by, "episode").orderBy(F.desc(ts))
    last = F.first(progress).over(back)
    still = F.sum(F.when(F.col(progress) != last, 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 0
    marked = rows.withColumn("_still", still)
    return marked.groupBy(*by, "episode").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("samples"), (F.max(progress) - F.min(progress)).alias("done"), (F.count_if("_still") >= 3).alias("stuck"))


TICKS = {"cpu_ticks": ("utime", "stime"), "block_wait_ticks": ("blkdelay_ticks",), "run_delay_ns": ("rundelay_ns",), "read_bytes": ("read_bytes",), "write_bytes": ("write_bytes",), "major_faults": ("majflt",)}


def vacuum_load(found: DataFrame, samples: DataFrame, by: list[str], ticks_per_second: int, scanned: str | None = None, ts: str = "ts", width: int = 86_400_000_000) -> DataFrame:
    """Episodes (by..., first_ts, last_ts) with what the process did meanwhile: changes of its counters between its samples at or before both ends.

    The load is unknown if there is no sample at or before the first row, or the
    same one serves both ends; a change is unknown where a counter fell or
    lacks a value, and a sum where one of its counters is. Shares are per cent
    of the time between the samples, and of the bytes in the column `scanned`.
    """
    fields = sorted({c for cs in TICKS.values() for c in cs} & set(samples.columns))
    ends = found.select(*by, F.col("first_ts").alias(ts)).union(found.select(*by, F.col("last_ts").alias(ts))).distinct()
    at = asof(ends, samples.select(*by, ts, *fields), by, fields, ts, width=width)
    side = lambda end, p: at.select(*[F.col(b).alias(f"_{p}_{b}") for b in by], F.col(ts).alias(f"_{p}_{end}"), F.struct("asof_ts", *fields).alias(p))
    rows = found
    for end, p in (("first_ts", "b"), ("last_ts", "a")):
        keys = [F.col(b).eqNullSafe(F.col(f"_{p}_{b}")) for b in by] + [F.col(end) == F.col(f"_{p}_{end}")]
        rows = rows.join(side(end, p), keys, "left").drop(*[f"_{p}_{b}" for b in by], f"_{p}_{end}")
    known, span = F.col("a.asof_ts") > F.col("b.asof_ts"), (F.col("a.asof_ts") - F.col("b.asof_ts")) / 1_000_000
    grown = lambda c: F.when(known & (F.col(f"a.{c}") >= F.col(f"b.{c}")), F.col(f"a.{c}") - F.col(f"b.{c}"))
    loads = {n: sum((grown(c) for c in cs[1:]), grown(cs[0])) for n, cs in TICKS.items() if set(cs) <= set(fields)}
    out = rows.select(*found.columns, F.when(known, span).alias("load_seconds"), *[c.alias(n) for n, c in loads.items()])
    ms = lambda c: F.col(c) * 1_000.0 / ticks_per_second
    if "cpu_ticks" in loads:
        out = out.withColumn("cpu_ms", ms("cpu_ticks")).withColumn("cpu_share", F.when((F.col("load_seconds") > 0) & F.col("cpu_ms").isNotNull(), F.least(F.lit(100.0), F.col("cpu_ms") / 10 / F.col("load_seconds"))))
    if "block_wait_ticks" in loads:
        out = out.withColumn("block_wait_ms", ms("block_wait_ticks"))
    if scanned is not None and "read_bytes" in loads:
        out = out.withColumn("read_share", F.when((F.col(scanned) > 0) & F.col("read_bytes").isNotNull(), F.least(F.lit(100.0), F.col("read_bytes") * 100.0 / F.col(scanned))))
    return out


def phase_runs(df: DataFrame, by: list[str], phase: str, ts: str = "ts") -> DataFrame:
    """(by..., episode, phase, since, rows): the phase that an episode ended in, since when without a break, and for how many rows."""
    back = Window.partitionBy(*by, "episode").orderBy(F.desc(ts))
    last = F.first(phase).over(back)
    broken = F.max(F.when(F.col(phase).eqNullSafe(last), 0).otherwise(1)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = df.withColumn("_broken", broken).where("_broken = 0")
    return held.groupBy(*by, "episode").agg(F.max_by(phase, ts).alias("phase"), F.min(ts).alias("since"), F.count(F.lit(1)).alias("rows"))
