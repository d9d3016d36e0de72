"""Statistics of relations grouped by database, schema, tablespace or object.

Members bring changes since their predecessor. A member whose change is unknown
makes its group's sum unknown; one to which a metric does not apply adds
nothing. Groups carry values and unknown flags as ordinary partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions import tristate
from gaugeloom.functions.conditions import Condition, phases
from gaugeloom.operators import snapshot


def members(df: DataFrame, identity: list[str], counters: list[str], ts: str = "ts") -> DataFrame:
    """Rows with d_<counter> and elapsed against the row of the same identity before; null where it fell or there is none."""
    w = Window.partitionBy(*identity).orderBy(ts)
    out = df.withColumn("elapsed", F.col(ts) - F.lag(ts).over(w))
    for c in counters:
        out = out.withColumn(f"d_{c}", F.when(F.col(c) >= F.lag(c).over(w), F.col(c) - F.lag(c).over(w)))
    return out


def grouped(df: DataFrame, by: list[str], changes: list[str], gauges: list[str] | None = None, neutral: list[str] | None = None, has: dict[str, str] | None = None) -> DataFrame:
    """n and per change its sum: unknown if a member's is unknown, unless the change is in `neutral`; gauges by maximum.

    `has` names for a gauge the flag column that tells whether the member's layout has it. Rows without a group key are left out.
    """
    neutral, has = neutral or [], has or {}
    keyed = df.where(" AND ".join(f"{k} IS NOT NULL" for k in by))
    sums = [tristate.total(F.col(c), F.lit(False) if c in neutral else F.col(c).isNull()).alias(c) for c in changes]
    tops = [tristate.maximum(F.col(g), ~F.col(has[g]) if g in has else F.lit(False)).alias(g) for g in gauges or []]
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), *sums, *tops)


def page(
    df: DataFrame, surface: str, by: list[str], wanted: Condition | None, counters: list[str], gauges: list[str], order: str, limit: int = 20, descending: bool = True, elapsed: str = "elapsed",
) -> DataFrame:
    """A page of groups of members (see members()): what the condition says of members holds before grouping, what it says of results after it.

    A group has its number of members, each counter's rate, unknown while a
    member's is, and each gauge's sum over the members that have it; with
    eligible, the number of groups that match, and truncated.
    """
    member, result = (F.lit(True), F.lit(True)) if wanted is None else phases(wanted, grouped=True)
    rates = [tristate.total(F.col(f"d_{c}").cast("double") * 1_000_000 / F.col(elapsed), F.col(f"d_{c}").isNull()).alias(c) for c in counters]
    keyed = df.where(" AND ".join(f"{k} IS NOT NULL" for k in by)).where(member)
    groups = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("table_count" if surface == "tables" else "index_count"), *rates, *[F.sum(g).alias(g) for g in gauges])
    return snapshot.page(groups.where(result), order, by, limit, descending)


def rate_sums(df: DataFrame, by: list[str], change: str, elapsed: str = "elapsed") -> DataFrame:
    """The sum of the members' rates, the same in whatever order they come.

    Changes over one elapsed time are added as whole numbers before they are
    divided. Quotients are whole numbers and rests: wholes are added as they
    are, rests as decimals of 18 places, so no partial sum is ever rounded.
    """
    exact = df.where(F.col(change).isNotNull() & (F.col(elapsed) > 0)).groupBy(*by, F.col(elapsed).cast("decimal(19,0)").alias("_e")).agg((F.sum(F.col(change).cast("decimal(19,0)")) * 1_000_000).cast("decimal(35,0)").alias("_d"))
    rest = F.col("_d") % F.col("_e")
    whole = F.call_function("div", (F.col("_d") - rest).cast("decimal(35,0)"), F.col("_e")).cast("decimal(38,0)")
    part = F.call_function("div", (rest.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)"), F.col("_e")).cast("decimal(38,0)")
    sums = exact.groupBy(*by).agg(F.sum(whole).alias("_w"), F.sum(part).alias("_p"))
    return sums.select(*by, (F.col("_w").cast("double") + F.col("_p").cast("double") / 1e18).alias("rate"))


def severities(df: DataFrame, by: list[str], valid: str, ready: str) -> DataFrame:
    """2 for an invalid member, 1 for one valid but not ready, 0 else; the highest, unknown if a member is; with flag counts."""
    level = F.when(~F.col(valid), 2).when(~F.col(ready), 1).when(F.col(valid) & F.col(ready), 0)
    counts = [F.when(~F.bool_or(F.col(c).isNull()), F.count_if(c)).alias(f"{c}_count") for c in (valid, ready)]
    return df.groupBy(*by).agg(tristate.maximum(level, level.isNull()).alias("severity"), *counts)


def latest_of_each(df: DataFrame, part: str, values: list[str], ts: str = "ts", moments: DataFrame | None = None) -> DataFrame:
    """(ts, parts, values...): at every time, the sums over the newest row of every part seen so far.

    The newest row changes a sum by the difference to the part's row before,
    so the running sum of differences per time is the merged value; no time is
    paired with every part. Differences are taken inside hours; the last row of
    the part's hour before is carried in, so no task sees all rows of a part.
    Of rows of one part and time the one with the largest values is the newest;
    rows without a time are left out. While a part's newest row lacks a value,
    the merged value is unknown.

    `moments` (part, ts) lists when parts were recorded. A part that was
    recorded and has no row is gone until it has one again; times at which no
    part is left have no row.
    """
    row = F.struct(ts, "_live", *values)
    rows = df.where(F.col(ts).isNotNull()).select(part, ts, *values, F.lit(True).alias("_live"))
    if moments is not None:
        seen = moments.where(F.col(ts).isNotNull()).select(part, ts).distinct()
        rows = rows.unionByName(seen.join(rows, [part, ts], "left_anti").withColumn("_live", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("_h", F.floor(F.col(ts) / 3_600_000_000))
    last = rows.groupBy(F.col(part).alias("_part"), F.col("_h").alias("_span")).agg(F.max(row).alias("_l"))
    carried = last.withColumn("_c", F.lag("_l").over(Window.partitionBy("_part").orderBy("_span"))).drop("_l")  # a row per part and hour
    before = F.coalesce(F.lag(row).over(Window.partitionBy(part, "_h").orderBy(ts, *values)), F.col("_c"))
    near = rows.join(carried, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_h") == F.col("_span"))).withColumn("_b", before)
    was, zero = F.coalesce(F.col("_b._live"), F.lit(False)), F.lit(0)
    changes = {"_new": F.col("_live").cast("int") - was.cast("int")}
    for v in values:  # what is gone has no value, and none that is unknown
        changes[f"_v_{v}"] = F.coalesce(F.col(v), zero) - F.coalesce(F.col(f"_b.{v}"), zero)
        changes[f"_u_{v}"] = (F.col("_live") & F.col(v).isNull()).cast("int") - (was & F.col(f"_b.{v}").isNull()).cast("int")
    at = near.select(ts, *[c.alias(n) for n, c in changes.items()]).groupBy(ts).agg(*[F.sum(n).alias(n) for n in changes])
    merged = running(at, ts, list(changes)).select(ts, F.col("_new").alias("parts"), *[F.when(F.col(f"_u_{v}") == 0, F.col(f"_v_{v}")).alias(v) for v in values])
    return merged if moments is None else merged.where("parts > 0")


def running(df: DataFrame, order: str, columns: list[str], width: int = 3_600_000_000) -> DataFrame:
    """Running sums in `order` without one task seeing all rows: inside hours, on top of the sums of the hours before."""
    part = df.withColumn("_h", F.floor(F.col(order) / width))
    hours = part.groupBy("_h").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    ahead = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)  # a row per hour
    before = hours.select("_h", *[F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_h").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return part.join(before, "_h").select(*[c for c in df.columns if c not in columns], *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(c) for c in columns])


def tablespace_history(df: DataFrame, partition: str, chosen: Column, identity: list[str], counters: list[str], start: int, stop: int, ts: str = "ts") -> DataFrame:
    """(ts, parts, members, d_<counter>): the members of a tablespace over all partitions (databases), at every time one of them was recorded.

    A partition counts with its newest moment's members until its next one; if
    that has no member in the tablespace any more, the partition goes.
    """
    rows = history(df, partition, [partition], identity, counters, 0, stop, ts, chosen)
    moments = df.where(F.col(ts) <= stop).select(partition, ts)
    merged = latest_of_each(rows, partition, ["members", *[f"d_{c}" for c in counters]], ts, moments)
    return merged.where(F.col(ts).between(start, stop))


def history(df: DataFrame, partition: str, group: list[str], identity: list[str], counters: list[str], start: int, stop: int, ts: str = "ts", chosen: Column | None = None) -> DataFrame:
    """(ts, group..., members, d_<counter>): per moment of a partition, sums of changes since its moment before.

    A member counts only if it was there in that moment; the moment before may lie ahead of `start`.
    Only `chosen` members are summed, moments are those of all.
    """
    times = df.where(F.col(ts) <= stop).select(partition, ts).distinct()
    chain = times.withColumn("_then", F.lag(ts).over(Window.partitionBy(partition).orderBy(ts))).where(F.col(ts).between(start, stop))
    keys = [partition, *[i for i in identity if i != partition]]
    then = df.select(*keys, F.col(ts).alias("_then"), *[F.col(c).alias(f"_b_{c}") for c in counters])
    now = df.where(F.col(ts).between(start, stop))
    rows = (now if chosen is None else now.where(chosen)).join(chain, [partition, ts]).join(then, [*keys, "_then"], "left")
    for c in counters:
        rows = rows.withColumn(f"d_{c}", F.when(F.col(c) >= F.col(f"_b_{c}"), F.col(c) - F.col(f"_b_{c}")))
    return rows.groupBy(ts, *group).agg(F.count(F.lit(1)).alias("members"), *[tristate.total(F.col(f"d_{c}"), F.lit(False)).alias(f"d_{c}") for c in counters])
