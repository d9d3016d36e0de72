"""Derived time series: lanes, summaries, health, transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions.counters import adjacent, delta, neighbours, predecessor

PRESSURE = ("cpu", "memory", "io")


def sum_then_rate(df: DataFrame, value: str, width: int, ts: str = "ts") -> DataFrame:
    """(ts, value, rate): sums over devices at each time, then the rate between neighbouring times."""
    at = df.groupBy(ts).agg(F.sum(value).alias(value))
    return neighbours(at, [value], ts, width).withColumn("rate", F.when(F.col(f"prev_{value}").isNotNull() & (F.col(value) >= F.col(f"prev_{value}")), (F.col(value) - F.col(f"prev_{value}")).cast("double") / ((F.col(ts) - F.col("prev_ts")) / 1_000_000)))


def process_summary(df: DataFrame, entity: list[str], counters: list[str], gauges: list[str], states: dict[str, Column] | None = None, ts: str = "ts") -> DataFrame:
    """Per moment: entities, of each counter the entities with a usable change, the sum of changes and of rates, sums of gauges, and how many are in each state.

    A change is usable against the moment right before, in which the same
    entity must have been: `entity` names pid and start time, so a number used
    again is another one. Sums of nothing known are null.
    """
    rows = predecessor(df, entity, counters, ts)
    sums = []
    for c in counters:
        change = F.when(F.col(ts) > F.col("prev_ts"), delta(F.col(f"prev_{c}"), F.col(c)))
        sums += [F.count(change).alias(f"{c}_usable"), F.sum(change).alias(f"{c}_change"), (F.sum(change) * 1_000_000 / (F.col(ts) - F.max("prev_ts"))).alias(f"{c}_per_s")]
    counted = [F.count_if(condition).alias(name) for name, condition in (states or {}).items()]
    return rows.groupBy(ts).agg(F.count(F.lit(1)).alias("entities"), *sums, *[F.sum(g).alias(g) for g in gauges], *counted)


def cpu_busy(d: dict[str, Column], seconds: Column, ticks: Column, cores: Column) -> Column:
    """Busy share in per cent; every tick counter is required."""
    busy = None
    for c in ("user", "nice", "system", "irq", "softirq", "steal"):
        busy = d[c] if busy is None else F.try_add(busy, d[c])
    return F.try_divide(busy.cast("double") * 100, seconds * ticks * cores)


def percent_left(stalled: Column, elapsed: Column) -> Column:
    """100 less the share of `elapsed`, rounded half up in whole numbers."""
    capped = F.least(stalled, elapsed)
    return 100 - F.floor((capped * 100 + F.floor(elapsed / 2)) / elapsed).cast("int")


def os_health(df: DataFrame, host: list[str], ts: str = "ts") -> DataFrame:
    """Per time 100 less the worst pressure share since the time before; null without all resources, or if one fell."""
    w = Window.partitionBy(*host).orderBy(ts)
    whole = F.col("cpu").isNotNull() & F.col("memory").isNotNull() & F.col("io").isNotNull()
    rows = df.withColumn("_ok", whole).withColumn("_e", F.col(ts) - F.lag(ts).over(w))
    stalls = [delta(F.lag(c).over(w), F.col(c)) for c in PRESSURE]
    known = F.col("_ok") & F.lag("_ok").over(w) & (F.col("_e") > 0)
    for s in stalls:
        known = known & s.isNotNull()
    return rows.withColumn("os_health", F.when(known, percent_left(F.greatest(*stalls), F.col("_e")))).drop("_ok", "_e")


def postgres_penalty(active: Column, cpus: Column) -> Column:
    """What more active backends than two per CPU cost, in per cent of them."""
    over = active - 2 * cpus
    return F.when(cpus > 0, F.when(over <= 0, 0).otherwise(F.round(100 * over / active).cast("int")))


def overall_health(os: Column, penalty: Column, enabled: Column | None = None) -> Column:
    """OS health less the penalty, not below 0; unknown if a part that counts is."""
    cost = penalty if enabled is None else F.when(enabled, penalty).otherwise(0)
    left = os - cost
    return F.when(left < 0, 0).otherwise(left)


def tps(df: DataFrame, database: str, commits: str, rollbacks: str, ts: str = "ts") -> DataFrame:
    """Transactions per second and database between neighbouring rows."""
    return adjacent(df.withColumn("_n", F.col(commits) + F.col(rollbacks)), [database], "_n", ts).withColumnRenamed("rate", "tps").drop("_n", "prev_value")


def surface_summary(df: DataFrame, entity: list[str], counters: list[str], ratios: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """Per time the number of entities, per counter the sum of rates, and ratios of changes.

    Rates count entities with a usable change; a ratio's two changes count
    together, only where both are usable. Nothing usable gives null.
    """
    w = Window.partitionBy(*entity).orderBy(ts)
    rows = df.withColumn("_e", F.col(ts) - F.lag(ts).over(w))
    for c in counters:
        rows = rows.withColumn(f"_d_{c}", delta(F.lag(c).over(w), F.col(c)))
    usable = lambda c: F.when(F.col("_e") > 0, F.col(f"_d_{c}"))
    sums = [F.sum(usable(c) * 1_000_000 / F.col("_e")).alias(f"{c}_per_s") for c in counters]
    both = {n: (F.sum(F.when(usable(b).isNotNull(), usable(a))), F.sum(F.when(usable(a).isNotNull(), usable(b)))) for n, (a, b) in ratios.items()}
    return rows.groupBy(ts).agg(F.count(F.lit(1)).alias("entities"), *sums, *[F.try_divide(a.cast("double"), b.cast("double")).alias(n) for n, (a, b) in both.items()])
