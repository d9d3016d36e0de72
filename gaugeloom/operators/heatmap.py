"""Rankings and time grids of many entities.

Observations are brought together per entity, cells are aggregates per entity
and column, and only the few winners are joined back by broadcast. grid(),
bands() and ranking() each look at one item, and scan for the ranking and for
the cells; batch() takes several items from one scan and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.functions.timeutil import TimeRange
from gaugeloom.operators.links import Rounds

MAX_TOP, MAX_COLUMNS = 500, 1_440


def total(kind: str, value: str, ts: str = "ts") -> Column:
    """An entity's total over the range: the maximum of a gauge; for a counter last minus first, by time."""
    if kind == "gauge":
        return F.max(value)
    first, last = F.min_by(value, ts), F.max_by(value, ts)
    return F.when((F.count(value) >= 2) & (F.max(ts) > F.min(ts)) & (last >= first), last - first)


def ranking(df: DataFrame, entity: str, value: str, kind: str, span: TimeRange, top: int, ts: str = "ts") -> DataFrame:
    """rank, entity, total of the `top` entities: total descending, unknown last, ties by the key's text; with the bands' totals.

    totals_total and others_total add counters and take the maximum of gauges.
    """
    if not 0 < top <= MAX_TOP:
        raise ValueError(f"top: 1 to {MAX_TOP}")
    seen = df.where(span.holds(ts) & F.col(value).isNotNull())
    totals = seen.groupBy(entity).agg(total(kind, value, ts).alias("total"))
    order = [F.col("total").desc_nulls_last(), F.col(entity).cast("string")]
    first = totals.orderBy(*order).limit(top + 1).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top + 1 rows
    won, of_first = F.col("rank") <= top, Window.partitionBy()
    first = first.withColumn("_won", F.sum(F.when(won, F.col("total"))).over(of_first)).withColumn("_known", F.count(F.when(won, F.col("total"))).over(of_first)).withColumn("_next", F.max(F.when(~won, F.col("total"))).over(of_first))
    every = totals.agg((F.sum if kind == "counter" else F.max)("total").alias("totals_total"), F.count(F.lit(1)).alias("entities"), F.count("total").alias("_all_known"))
    rest = F.col("totals_total") - F.coalesce("_won", F.lit(0)) if kind == "counter" else F.col("_next")  # in order, the next is the largest of the rest
    others = F.when(F.col("_all_known") > F.col("_known"), rest)
    return first.where(won).crossJoin(F.broadcast(every)).select("rank", entity, "total", "totals_total", others.alias("others_total"), "entities")


def check_fields(layout, fields: list[str], groups: list[str] = ()) -> str:
    """The kind, gauge or counter, of fields that can share a map: of one class and unit; groups are labels, at most four of either."""
    if not 0 < len(fields) <= 4 or len(groups) > 4:
        raise ValueError("one to four fields and at most four groups")
    meta = {(layout.schema[f].metadata["class"], layout.schema[f].metadata.get("unit")) for f in fields}
    if len(meta) > 1 or next(iter(meta))[0] not in ("gauge", "cumulative"):
        raise ValueError("fields must be counters or gauges of one unit")
    if any(layout.schema[g].metadata["class"] != "label" for g in groups):
        raise ValueError("groups must be labels")
    return "counter" if next(iter(meta))[0] == "cumulative" else "gauge"


def out_of_order(df: DataFrame, entity: str, span: TimeRange, columns: int, order: str, ts: str = "ts") -> DataFrame:
    """entity, late: observations that come, in recorded order, after one of a later column."""
    w = Window.partitionBy(entity).orderBy(order)
    col = F.floor((F.col(ts) - span.start) * columns / (span.stop - span.start))
    reached = F.max("_col").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.where(span.holds(ts)).withColumn("_col", col).withColumn("_late", F.col("_col") < reached).groupBy(entity).agg(F.count_if("_late").alias("late"))


def cells(df: DataFrame, entity: list[str], value: str, kind: str, span: TimeRange, columns: int, ts: str = "ts") -> DataFrame:
    """(entity..., col, cell): the last value of a gauge, the rate of a counter, per column of the range.

    An observation belongs to the column of the middle between it and the one
    before. A counter's first observation in a column also sees the one before
    as its base, so no change between columns is lost.
    """
    if not 0 < columns <= MAX_COLUMNS:
        raise ValueError(f"columns: 1 to {MAX_COLUMNS}")
    w = Window.partitionBy(*entity).orderBy(ts)
    seen = df.where(span.holds(ts) & F.col(value).isNotNull()).withColumn("_pts", F.lag(ts).over(w)).withColumn("_pv", F.lag(value).over(w))
    placed = seen.withColumn("col", span.column_of(F.col("_pts"), F.col(ts), columns))
    if kind == "gauge":
        return placed.groupBy(*entity, "col").agg(F.max_by(value, ts).alias("cell"))
    ends = placed.groupBy(*entity, "col").agg(
        F.min(F.coalesce("_pts", ts)).alias("t0"), F.min_by(F.coalesce("_pv", value), F.col(ts)).alias("v0"), F.max(ts).alias("t1"), F.max_by(value, ts).alias("v1"),
    )
    rate = (F.col("v1") - F.col("v0")).cast("double") / ((F.col("t1") - F.col("t0")) / 1_000_000)
    return ends.select(*entity, "col", F.when((F.col("t1") > F.col("t0")) & (F.col("v1") >= F.col("v0")), rate).alias("cell"))


def grid(df: DataFrame, entity: str, value: str, kind: str, span: TimeRange, columns: int, top: int, ts: str = "ts") -> DataFrame:
    """rank, entity, col, cell of the ranked entities' known cells."""
    best = ranking(df, entity, value, kind, span, top, ts).select("rank", entity)
    found = cells(df, [entity], value, kind, span, columns, ts)
    return found.join(F.broadcast(best), entity).where("cell IS NOT NULL").select("rank", entity, "col", "cell")


def bands(df: DataFrame, entity: str, value: str, kind: str, span: TimeRange, columns: int, top: int, ts: str = "ts") -> DataFrame:
    """col, totals, others: sums of all cells and of those outside the ranking; null where nothing contributes."""
    best = ranking(df, entity, value, kind, span, top, ts).select(entity, F.lit(True).alias("_won"))
    found = cells(df, [entity], value, kind, span, columns, ts).join(F.broadcast(best), entity, "left")
    return found.groupBy("col").agg(F.sum("cell").alias("totals"), F.sum(F.when(F.col("_won").isNull(), F.col("cell"))).alias("others"), F.count("cell").alias("contributors"))


def observed(df: DataFrame, entity: str, items: dict[str, tuple[str, str]], span: TimeRange, columns: int, ts: str = "ts") -> DataFrame:
    """item, entity, total, cells: per item and entity its total over the range and its known cells (col, cell), `columns` at most.

    `items` are name: (value column, "gauge" or "counter"). All items come from
    one scan and one shuffle by entity, since cells and totals of an entity are
    made where its rows are. A gauge's cell is its last value, as a double.
    """
    if not items or not 0 < columns <= MAX_COLUMNS:
        raise ValueError(f"one item at least, and 1 to {MAX_COLUMNS} columns")
    before = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    whole = all(df.schema[v].dataType.typeName() in ("byte", "short", "integer", "long") for v, _ in items.values())
    value = lambda v: F.col(v).cast("long" if whole else "double")
    seen = df.where(span.holds(ts)).select(entity, ts, *{v for v, _ in items.values()})
    each = []
    for k, (v, _) in enumerate(items.values()):
        seen = seen.withColumn(f"_b{k}", F.last(F.when(F.col(v).isNotNull(), F.struct(F.col(ts).alias("t"), value(v).alias("v"))), ignorenulls=True).over(before))
        each.append(F.when(F.col(v).isNotNull(), F.struct(F.lit(k).alias("k"), value(v).alias("v"), F.col(f"_b{k}").alias("b"))))
    rows = seen.select(entity, ts, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select(entity, ts, "x.*")
    placed = rows.withColumn("col", span.column_of(F.col("b.t"), F.col(ts), columns))
    parts = placed.groupBy(entity, "k", "col").agg(
        F.min(F.coalesce("b.t", ts)).alias("t0"), F.min_by(F.coalesce("b.v", "v"), ts).alias("v0"), F.min(F.struct(ts, "v")).alias("first"), F.max(F.struct(ts, "v")).alias("last"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"),
    )
    counter = F.element_at(F.array(*[F.lit(kind == "counter") for _, kind in items.values()]), F.col("k") + 1)
    grown = F.when((F.col(f"last.{ts}") > F.col("t0")) & (F.col("last.v") >= F.col("v0")), (F.col("last.v") - F.col("v0")).cast("double") / ((F.col(f"last.{ts}") - F.col("t0")) / 1_000_000))
    cell = F.when(counter, grown).otherwise(F.col("last.v").cast("double"))
    got = parts.withColumn("cell", cell).groupBy(entity, "k").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("most").alias("most"), F.sum("n").alias("n"), F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("col", "cell"))).alias("cells"),
    )
    change = F.when((F.col("n") >= 2) & (F.col(f"last.{ts}") > F.col(f"first.{ts}")) & (F.col("last.v") >= F.col("first.v")), F.col("last.v") - F.col("first.v"))
    name = F.element_at(F.array(*map(F.lit, items)), F.col("k") + 1)
    return got.select(name.alias("item"), entity, F.when(counter, change).otherwise(F.col("most")).alias("total"), "cells")


def batch(df: DataFrame, entity: str, items: dict[str, tuple[str, str]], span: TimeRange, columns: int, top: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """((item, rank, entity, total, col, cell) of the ranked entities, (item, col, totals, others, contributors)) of several items.

    The observations are scanned once; a row per entity and item is written to
    the folder that driver and executors share, and all else is read from there.
    """
    if not 0 < top <= MAX_TOP:
        raise ValueError(f"top: 1 to {MAX_TOP}")
    rows = Rounds(df.sparkSession).written(observed(df, entity, items, span, columns, ts))
    order = Window.partitionBy("item").orderBy(F.col("total").desc_nulls_last(), F.col(entity).cast("string"))
    won = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task hands on `top` rows an item
    grids = won.select("item", "rank", entity, "total", F.explode("cells").alias("c")).select("item", "rank", entity, "total", "c.*")
    winners = F.broadcast(won.select(F.col("item").alias("_i"), F.col(entity).alias("_e"), F.lit(True).alias("_won")))
    marked = rows.join(winners, (F.col("item") == F.col("_i")) & F.col(entity).eqNullSafe(F.col("_e")), "left").select("item", "_won", F.explode("cells").alias("c"))
    sums = marked.groupBy("item", "c.col").agg(F.sum("c.cell").alias("totals"), F.sum(F.when(F.col("_won").isNull(), F.col("c.cell"))).alias("others"), F.count(F.lit(1)).alias("contributors"))
    return grids, sums


def grouped_grid(df: DataFrame, entity: str, group: str, value: str, kind: str, span: TimeRange, columns: int, top: int, ts: str = "ts") -> DataFrame:
    """rank, group, members, total, col, cell: entities grouped by a column as of their first observation; totals and cells add up."""
    seen = df.where(span.holds(ts) & F.col(value).isNotNull())
    of_entity = seen.groupBy(entity).agg(F.min_by(group, ts).alias("_group"), total(kind, value, ts).alias("total"), F.min(ts).alias("_first"))
    groups = of_entity.groupBy("_group").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("members"), F.min("_first").alias("_first"))
    order = [F.col("total").desc_nulls_last(), F.col("_first")]
    best = groups.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `top` rows
    found = cells(df, [entity], value, kind, span, columns, ts).join(of_entity.select(entity, "_group"), entity)
    summed = found.groupBy("_group", "col").agg(F.sum("cell").alias("cell"))
    return summed.join(F.broadcast(best), "_group").where("cell IS NOT NULL").select("rank", F.col("_group").alias(group), "members", "total", "col", "cell")


def shared_mean(df: DataFrame, entity: str, value: str, span: TimeRange, top: int, ts: str = "ts") -> DataFrame:
    """Ranking by an entity's summed values over the number of moments at which any entity has a value."""
    seen = df.where(span.holds(ts) & F.col(value).isNotNull())
    count = seen.agg(F.countDistinct(ts).alias("moments"))
    sums = seen.groupBy(entity).agg(F.sum(value).alias("_s")).crossJoin(F.broadcast(count))
    means = sums.select(entity, (F.col("_s").cast("double") / F.col("moments")).alias("mean"))
    order = [F.desc("mean"), F.col(entity).cast("string")]
    return means.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def latest_label(df: DataFrame, entity: str, label: str, ts: str = "ts") -> DataFrame:
    """Each entity's last non-null label."""
    return df.where(F.col(label).isNotNull()).groupBy(entity).agg(F.max_by(label, ts).alias(label))


def intensity(cell: Column, most: Column) -> Column:
    """A colour step from 0 to 6 by the square root of the share."""
    return F.when(cell <= 0, 0).otherwise(F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(6 * F.sqrt(cell / most)))).cast("int"))
