"""Snapshots as of a time: the rows of the latest moment, counters as rates against the moment before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions.counters import rate

FEW_PARTITIONS = 10_000


def at_moment(df: DataFrame, at: int, ts: str = "ts") -> DataFrame:
    """All rows of the latest moment at or before `at`. The moment is looked up first, so that the scan of the rows filters by it."""
    return df.where(F.col(ts) == _last(df.where(F.col(ts) <= at), ts))


def _last(df: DataFrame, ts: str) -> Column:
    """The largest time as a literal, null if there is none: an aggregate that reads one column."""
    return F.lit(df.agg(F.max(ts)).first()[0]).cast(df.schema[ts].dataType)


def with_rates(df: DataFrame, at: int, identity: list[str], counters: list[str], same: list[str] | None = None, ts: str = "ts", look_back: int | None = None) -> DataFrame:
    """Rows of the current moment; each counter as a rate against the same entity in the moment right before.

    `same` lists columns, such as a start time, that must also be equal: a
    number used again is another entity. Entities absent from the moment
    before have no rates. A moment older than `look_back` shows nothing. Both
    moments are looked up first, so that each scan filters by one time.
    """
    seen = df.where(F.col(ts) <= at)
    now_ts = _last(seen if look_back is None else seen.where(F.col(ts) >= at - look_back), ts)
    keys = identity + (same or [])
    then = df.where(F.col(ts) == _last(df.where(F.col(ts) < now_ts), ts)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_ts"), *[F.col(c).alias(f"_b_{c}") for c in counters])
    now = df.where(F.col(ts) == now_ts)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = now.join(then, on, "left")
    return joined.select(*[c for c in df.columns if c not in counters], *[rate(F.col(f"_b_{c}"), F.col(c), F.col("_ts"), F.col(ts)).alias(c) for c in counters])


def partitioned(df: DataFrame, at: int, partition: str, identity: list[str], counters: list[str], look_back: int | None = None, ts: str = "ts", layout: str | None = None) -> DataFrame:
    """As with_rates, with each partition's own two latest moments. Moments older than `look_back` show nothing.

    With `layout`, a column that numbers layouts, only rows of a moment's newest
    layout count, per partition. The moments, a row per partition, are looked
    up first: if there are at most FEW_PARTITIONS, they are literals that the
    one scan of the rows is joined with, and it starts at the earliest of them;
    only rows of two moments are shuffled then.
    """
    seen = df.where(F.col(ts) <= at)
    numbers = F.coalesce(F.col(layout).cast("long"), F.lit(0).cast("long")) if layout else F.lit(0).cast("long")
    times = seen.groupBy(F.col(partition).alias("_p"), F.col(ts).alias("_t")).agg(F.max(numbers).alias("_l"))
    nth = Window.partitionBy("_p").orderBy(F.desc("_t"))
    two = times.withColumn("_n", F.row_number().over(nth)).where("_n <= 2").groupBy("_p").agg(*[F.max(F.when(F.col("_n") == n, F.struct("_t", "_l"))).alias(m) for n, m in ((1, "_now"), (2, "_then"))])
    if look_back is not None:
        two = two.where(F.col("_now._t") >= at - look_back)
    found = two.limit(FEW_PARTITIONS + 1).collect()
    if len(found) <= FEW_PARTITIONS:
        two = F.broadcast(df.sparkSession.createDataFrame(found, two.schema))
        seen = seen.where(F.col(ts) >= F.lit(min((r["_then"] or r["_now"])["_t"] for r in found) if found else None))
    moment = F.struct(F.col(ts).alias("_t"), numbers.alias("_l"))
    rows = seen.join(two, F.col(partition).eqNullSafe(F.col("_p"))).withColumn("_m", moment).where((F.col("_m") == F.col("_now")) | F.coalesce(F.col("_m") == F.col("_then"), F.lit(False)))
    keys = [partition, *[k for k in identity if k != partition]]
    before = F.last(F.struct(ts, *counters)).over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1))
    now = rows.withColumn("_b", before).where(F.col("_m") == F.col("_now"))
    return now.select(*[c for c in df.columns if c not in counters], *[rate(F.col(f"_b.{c}"), F.col(c), F.col(f"_b.{ts}"), F.col(ts)).alias(c) for c in counters])


def look_back_of(cadence_seconds: float) -> int:
    """How old a finder's rows may be, in microseconds."""
    return int(max(2.5 * cadence_seconds, 20) * 1_000_000)


def page(df: DataFrame, order: str, ties: list[str], limit: int, descending: bool = True, eligible: bool = True) -> DataFrame:
    """The first rows by a value, nulls last in either direction, ties by `ties`; with eligible and truncated."""
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    first = df.orderBy(key, *ties).limit(limit)
    if not eligible:
        return first
    count = df.agg(F.count(F.lit(1)).alias("eligible"))
    return first.crossJoin(F.broadcast(count)).withColumn("truncated", F.col("eligible") > limit)


def after(order: str, ties: list[str], cursor: dict, descending: bool = True) -> Column:
    """What of a page's order comes behind the row that `cursor` holds the order value and ties of: a bound, not a number of rows to skip."""
    value = cursor[order]
    same = F.col(order).eqNullSafe(F.lit(value))
    behind = F.lit(False)
    known = lambda c: F.coalesce(c, F.lit(False))
    for t in reversed(ties):  # nulls come first among ties
        later = F.col(t).isNotNull() if cursor[t] is None else known(F.col(t) > cursor[t])
        behind = later | (F.col(t).eqNullSafe(F.lit(cursor[t])) & behind)
    if value is None:
        return same & behind
    return known(F.col(order) < value if descending else F.col(order) > value) | F.col(order).isNull() | (same & behind)


def cursor_of(row, order: str, ties: list[str]) -> dict:
    """The cursor behind a page's last row."""
    return {k: row[k] for k in (order, *ties)}


def page_facts(df: DataFrame, limit: int, ts: str = "ts") -> DataFrame:
    """One row about what a page is taken from: eligible, returned, truncated, and the times that it spans."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("eligible"), F.least(n, F.lit(limit)).cast("long").alias("returned"), (n > limit).alias("truncated"), F.min(ts).alias("sample_from"), F.max(ts).alias("sample_to"))


def detail_of_one(df: DataFrame, identity: list[str], counters: list[str], where: Column, ts: str = "ts") -> DataFrame:
    """As row_detail for the one row that matches, which is read first: the scan for its predecessor filters by its identity and time. An error if none or several match."""
    found = df.where(where).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'several rows' if found else 'no row'} for a detail")
    row, held = found[0], df.schema
    lit = lambda c: F.lit(row[c]).cast(held[c].dataType)
    earlier = df.where(F.col(ts) < lit(ts))
    for k in identity:
        earlier = earlier.where(F.col(k) == lit(k) if row[k] is not None else F.col(k).isNull())
    before = earlier.agg(F.max_by(F.struct(ts, *counters), ts).alias("_b"))
    rates = [rate(F.col(f"_b.{c}"), lit(c), F.col(f"_b.{ts}"), lit(ts)).alias(f"{c}_rate") for c in counters]
    return before.select(*[lit(c).alias(c) for c in df.columns], F.col(f"_b.{ts}").alias("previous_ts"), *rates)


def row_detail(df: DataFrame, identity: list[str], counters: list[str], where: Column | None = None, ts: str = "ts") -> DataFrame:
    """Stored rows with counters as rates against the newest earlier row of the same identity, however old. For many rows; see detail_of_one."""
    w = Window.partitionBy(*identity).orderBy(ts)
    out = df.withColumn("previous_ts", F.lag(ts).over(w))
    for c in counters:
        out = out.withColumn(f"{c}_rate", rate(F.lag(c).over(w), F.col(c), F.lag(ts).over(w), F.col(ts)))
    return out if where is None else out.where(where)


def first_match(df: DataFrame, where, recency: str) -> DataFrame:
    """The most recent row that matches."""
    return df.where(where).orderBy(F.desc(recency)).limit(1)
