"""Groups and occurrences of recorded log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
MAX_WINDOW, MAX_OCCURRENCES = 60 * MINUTE, 5_000


def shared_text(column: str) -> Column:
    """The value if all members have one and the same, not empty."""
    same = (F.min(column) == F.max(column)) & (F.count(column) == F.count(F.lit(1))) & (F.min(column) != "")
    return F.when(same, F.min(column))


def minutes(ts: Column, start: int) -> Column:
    return F.floor((ts - start) / MINUTE).cast("int")


def groups(df: DataFrame, key: list[str], weight: Column, start: int, ts: str = "ts", order: str = "event_id", score: Column | None = None) -> DataFrame:
    """A row per key: count (summed weights, missing ones 1), first and last time, the representative row's id, minute sums.

    The representative is the earliest row, or with `score` the one that
    scores highest, the earliest of equals. Minutes are a sparse map: of the
    window's 60 only those with events.
    """
    w = F.coalesce(weight, F.lit(1)).cast("long")
    rows = df.withColumn("_w", w).withColumn("_m", minutes(F.col(ts), start))
    pick = F.min_by(order, F.struct(ts, order)) if score is None else F.max_by(order, F.struct(score, -F.col(ts), -F.col(order)))
    by_minute = rows.where(F.col("_m").between(0, 59)).groupBy(*key, "_m").agg(F.sum("_w").alias("_n"))
    strips = by_minute.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_m", "_n")))).alias("by_minute"))
    out = rows.groupBy(*key).agg(F.sum("_w").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), pick.alias("representative"))
    joined = out.join(strips.select(*[F.col(k).alias(f"_k_{k}") for k in key], "by_minute"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    return joined.drop(*[f"_k_{k}" for k in key])


def error_tier(severity: Column) -> Column:
    return F.when(severity.isin("FATAL", "PANIC"), "critical").when(severity.isin("WARNING", "LOG"), "routine").otherwise("notable")


def in_order(df: DataFrame, tier: str, count: str, last_ts: str, key: str) -> DataFrame:
    """Most pressing tier first, then the most frequent, the latest, and the key by English collation, then by bytes."""
    place = F.when(F.col(tier) == "critical", 0).when(F.col(tier) == "notable", 1).otherwise(2)
    return df.orderBy(place, F.desc(count), F.desc(last_ts), F.collate(F.col(key), "en_USA"), F.col(key))


def occurrences(df: DataFrame, start: int, stop: int, sources: list[str], limit: int, source: str = "source", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Single events by (time, place of the source in the request, order), one more than `limit` to tell truncation."""
    if stop - start > MAX_WINDOW or not 0 < limit <= MAX_OCCURRENCES:
        raise ValueError("a window of at most an hour and 1 to 5000 occurrences")
    place = F.array_position(F.array(*map(F.lit, sources)), F.col(source))
    rows = df.where(F.col(ts).between(start, stop) & F.col(source).isin(sources)).withColumn("source_rank", place.cast("int") - 1)
    found = rows.orderBy(ts, "source_rank", order).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(ts, "source_rank", order))  # limit + 1 rows
    return found.withColumn("_n", nth).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def lock_matches(waiting: DataFrame, acquired: DataFrame, keys: list[str], holders: str, ts: str = "ts") -> DataFrame:
    """Each acquired row with the holders of the latest wait of the same keys at or before it."""
    both = waiting.select(*keys, ts, F.col(holders).alias("_h"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("event_id")).unionByName(
        acquired.select(*keys, ts, F.lit(None).cast(waiting.schema[holders].dataType).alias("_h"), F.lit(1).alias("_side"), F.col("event_id").cast("long"))
    )
    w = Window.partitionBy(*keys).orderBy(ts, "_side", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("holders", F.last("_h", ignorenulls=True).over(w)).where("_side = 1").select("event_id", *keys, ts, "holders")


def checkpoints(df: DataFrame, phase: str, reason: str, sync: str, buffers: str) -> DataFrame:
    """One row: runs, timed and requested starts, longest sync, buffers written."""
    starts, ends = F.count_if(F.col(phase) == 0), F.count_if(F.col(phase) == 1)
    timed = F.count_if((F.col(phase) == 0) & F.col(reason).contains("time"))
    return df.agg(F.greatest(starts, ends).alias("n"), timed.alias("timed"), (starts - timed).alias("requested"), F.max(sync).alias("max_sync"), F.sum(buffers).alias("buffers"))


def autovacuum(df: DataFrame, kind: str, relation: str, elapsed: str, removed: str, dead: str, ts: str = "ts") -> DataFrame:
    """Runs by kind and relation, with sums and the latest row's dead tuples, which may be null."""
    return df.groupBy(kind, relation).agg(F.count(F.lit(1)).alias("n"), F.sum(elapsed).alias("elapsed"), F.sum(removed).alias("removed"), F.max_by(F.struct(dead), ts)[dead].alias("dead"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def checkpoint_warnings(df: DataFrame, phase: str, seconds: str) -> DataFrame:
    """One row if checkpoints came too often (phase 2): how often, and the shortest time between two."""
    return df.where(F.col(phase) == 2).agg(F.count(F.lit(1)).alias("n"), F.min(seconds).alias("least_seconds")).where("n > 0").withColumn("tier", F.lit("notable"))


def lifecycle(df: DataFrame, kind: str) -> DataFrame:
    """Starts, stops and crashes: every row is a group of its own; kind 0 is critical."""
    return df.withColumn("n", F.lit(1).cast("long")).withColumn("tier", F.when(F.col(kind) == 0, "critical").otherwise("notable"))


def pooler_groups(df: DataFrame, level: str, text: str, shared: list[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The pooler's lines by level and exact text: rows, first and last time, the earliest row, fields that all members share.

    Levels 0, 1 to 2 and the rest are critical, notable and routine.
    """
    out = df.groupBy(level, text).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min_by(order, F.struct(ts, order)).alias("representative"), *[shared_text(c).alias(c) for c in shared]
    )
    return out.withColumn("tier", F.when(F.col(level) == 0, "critical").when(F.col(level).isin(1, 2), "notable").otherwise("routine"))


def unmatched(matched: DataFrame, target: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """One row for acquired locks without a wait (see lock_matches): occurrences, the first one's id, targets in order of their first occurrence."""
    rows = matched.where("holders IS NULL")
    first = rows.groupBy(target).agg(F.min(F.struct(ts, order)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_f", target))), lambda x: x[target])
    return first.agg(F.sum("_n").alias("n"), F.min("_f")[order].alias("representative"), listed.alias("targets")).where("n > 0")


def slow_threshold(settings: DataFrame, name: str, value: str, unit: str, ts: str = "ts", order: str = "event_id", until: int | None = None) -> DataFrame:
    """One row: the latest log_min_duration_statement in ms (at or before `until`), null if it is negative or there is none.

    Of several at one time the first in recorded `order` counts.
    """
    settings = settings if until is None else settings.where(F.col(ts) <= until)
    x = F.col(value).cast("double") * F.when(F.col(unit) == "s", 1_000).when(F.col(unit) == "min", 60_000).otherwise(1)
    return settings.where(F.col(name) == "log_min_duration_statement").agg(F.max_by(F.when(x >= 0, x), F.struct(ts, -F.col(order))).alias("threshold_ms"))


def waits(df: DataFrame, holders: str, pid: str, target: str, duration: str, ts: str = "ts") -> DataFrame:
    """Lock waits by their holders: distinct waiters, longest wait, targets in order of their first wait."""
    targets = df.groupBy(holders, target).agg(F.min(ts).alias("_t"))
    named = targets.groupBy(holders).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", target))), lambda x: x[target]).alias("targets"))
    out = df.groupBy(holders).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(pid).alias("waiters"), F.max(duration).alias("longest"))
    return out.join(named, holders)
