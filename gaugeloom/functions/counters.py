"""Counters, predecessors and as-of lookups.

A counter's change is known only where it did not fall; a rate needs time to
have passed. Everything here is a window or a join on keys, so Spark partitions
it by entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta(before: Column, after: Column) -> Column:
    """after - before; null where either is null or the counter fell."""
    return F.when(after >= before, after - before)


def rate(before: Column, after: Column, before_ts: Column, after_ts: Column) -> Column:
    """Change per second; null where the change is unknown or no time passed."""
    seconds = (after_ts - before_ts) / 1_000_000
    return F.when(after_ts > before_ts, delta(before, after).cast("double") / seconds)


def adjacent(df: DataFrame, by: list[str], value: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """df with prev_ts, prev_value, delta and rate against the row before. A null value also hides the row before from the next one."""
    w = Window.partitionBy(*by).orderBy(ts, *([tie] if tie else []))
    out = df.withColumn("prev_ts", F.lag(ts).over(w)).withColumn("prev_value", F.lag(value).over(w))
    before, after = F.col("prev_value"), F.col(value)
    return out.withColumn("delta", delta(before, after)).withColumn("rate", rate(before, after, F.col("prev_ts"), F.col(ts)))


def asof(left: DataFrame, right: DataFrame, by: list[str], values: list[str], ts: str = "ts", tolerance: int | None = None, width: int | None = None) -> DataFrame:
    """left with the `values` of right's latest row at or before each left row's time, per `by`.

    Both sides are laid in one order and the last right row is carried on, so
    no pair of rows is compared. Right rows must be unique per key and time.
    Equal keys follow each other in one partition only if `by` spreads them.
    With `width`, only rows of one key and span of that width do, and the last
    right row of the spans before is carried in.
    """
    tag = F.struct(F.col(ts).alias("at"), *values)
    both = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.select(tag.alias("x")).schema["x"].dataType).alias("_right"))
    lookups = right.select(*[F.col(c) if c in (*by, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), tag.alias("_right"))
    span = F.lit(0) if width is None else F.floor(F.col(ts) / width)
    both = both.unionByName(lookups).withColumn("_p", span)
    keys = [*by, "_p"]
    w = Window.partitionBy(*(by if width is None else keys)).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if width is not None:
        last = both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col(ts))).alias("_l"))
        ahead = Window.partitionBy(*[f"_k_{k}" for k in by]).orderBy("_k__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and span
        carried = last.withColumn("_c", F.last("_l", ignorenulls=True).over(ahead)).drop("_l")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        found = found.join(carried, same).withColumn("_right", F.coalesce("_right", "_c"))
    if tolerance is not None:
        found = found.withColumn("_right", F.when(F.col(ts) - F.col("_right.at") <= tolerance, F.col("_right")))
    return found.select(*left.columns, F.col("_right.at").alias("asof_ts"), *[F.col(f"_right.{v}").alias(v) for v in values])


def preceded(left: DataFrame, right: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """left's rows that have a row of right at or before their time, per `by`. Only the first time of each key of right is joined."""
    first = right.groupBy(*by).agg(F.min(ts).alias("_first"))
    return left.join(first, by).where(F.col("_first") <= F.col(ts)).select(*left.columns)


def moments(df: DataFrame, at: int, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(by..., current_ts, previous_ts): the latest moment at or before `at`, and the one before it. One row per `by`."""
    by = by or []
    seen = df.where(F.col(ts) <= at)
    current = seen.groupBy(*by).agg(F.max(ts).alias("current_ts"))
    earlier = seen.join(F.broadcast(current) if not by else current, by) if by else seen.crossJoin(F.broadcast(current))
    previous = earlier.where(F.col(ts) < F.col("current_ts")).groupBy(*by, "current_ts").agg(F.max(ts).alias("previous_ts"))
    return current.join(previous, [*by, "current_ts"], "left")


def neighbours(at: DataFrame, values: list[str], ts: str, width: int) -> DataFrame:
    """Rows (one per time) with the row before: inside spans of `width`, and across them by the last row of the span before."""
    part = at.withColumn("_p", F.floor(F.col(ts) / width))
    last = part.groupBy("_p").agg(F.max_by(F.struct(ts, *values), ts).alias("_l"))
    carried = last.withColumn("_c", F.lag("_l").over(Window.orderBy("_p"))).select("_p", "_c")  # a row per span
    w = Window.partitionBy("_p").orderBy(ts)
    out = part.join(carried, "_p").withColumn("_b", F.coalesce(F.lag(F.struct(ts, *values)).over(w), F.col("_c")))
    return out.select(*at.columns, F.col(f"_b.{ts}").alias("prev_ts"), *[F.col(f"_b.{v}").alias(f"prev_{v}") for v in values])


def predecessor(df: DataFrame, identity: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """Rows with the values that the same entity had in the moment right before, not merely earlier.

    An entity that was absent from that moment has none. Moments are the
    distinct times of df; they are chained day by day.
    """
    chain = neighbours(df.select(ts).distinct(), [], ts, 86_400_000_000).withColumnRenamed("prev_ts", "_prev")
    before = df.select(*identity, F.col(ts).alias("_prev"), *[F.col(v).alias(f"prev_{v}") for v in values])
    return df.join(chain, ts).join(before, [*identity, "_prev"], "left").withColumnRenamed("_prev", "prev_ts")
