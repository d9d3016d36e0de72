"""Rows of recorded sections: projection, filters, layout unions, pages, catalog and slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, fields: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """`fields` in the caller's order; one that this layout lacks is null."""
    kinds = kinds or {}
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast(kinds.get(f, "string")).alias(f) for f in fields])


def typed_equals(df: DataFrame, labels: dict[str, object]) -> DataFrame:
    """Rows whose label columns equal the values; a layout without one of the columns matches nothing. -0.0 and 0.0 differ."""
    conditions: list[Column] = []
    for name, value in labels.items():
        if name not in df.columns:
            conditions.append(F.lit(False))
        elif isinstance(value, float):
            conditions.append(F.col(name).cast("string") == F.lit(value).cast("string"))
        else:
            conditions.append(F.col(name) == F.lit(value))
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def union_layouts(layouts: dict[int, DataFrame]) -> DataFrame:
    """Rows of all layouts of one section, with type_id; a column that a layout lacks is null, and has_<column> tells so."""
    every = list(dict.fromkeys(c for df in layouts.values() for c in df.columns))
    kinds = {f.name: f.dataType for df in layouts.values() for f in df.schema.fields}
    partial = [c for c in every if any(c not in df.columns for df in layouts.values())]
    parts = [
        df.select(F.lit(tid).alias("type_id"), *[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in every], *[F.lit(c in df.columns).alias(f"has_{c}") for c in partial])
        for tid, df in layouts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def page(df: DataFrame, order: str, limit: int, after: int | None = None, descending: bool = False) -> DataFrame:
    """A keyset page by physical order and whether more rows follow. At most limit + 1 rows leave the scan's tasks."""
    if after is not None:
        df = df.where(F.col(order) < after if descending else F.col(order) > after)
    key = F.col(order).desc() if descending else F.col(order).asc()
    found = df.orderBy(key).limit(limit + 1)
    more = found.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return found.orderBy(key).limit(limit).crossJoin(F.broadcast(more))  # one row


def catalog(sections: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """name, rows, fields, min_ts, max_ts of each section; the time is a column of microseconds, or none."""
    parts = []
    for name, (df, ts) in sections.items():
        low, high = (F.min(ts), F.max(ts)) if ts else (F.lit(None), F.lit(None))
        parts.append(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("fields"), low.cast("long").alias("min_ts"), high.cast("long").alias("max_ts")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def slice_rows(df: DataFrame, start: int, stop: int, semantics: str, context: int = 30_000_000, ts: str = "ts") -> DataFrame:
    """Rows from start to stop, both included, and the context that their semantics ask for.

    Event streams need none. Sections that record changes keep all rows of the
    context on either side. Snapshots keep the nearest moment on either side,
    whole. The two moments are scalars, so the rows are scanned, not shuffled.
    """
    inside = F.col(ts).between(start, stop)
    if semantics == "event_stream":
        return df.where(inside)
    near = df.where(F.col(ts).between(start - context, stop + context))
    if semantics in ("changed", "on_change"):
        return near
    edges = near.agg(F.max(F.when(F.col(ts) < start, F.col(ts))).alias("_low"), F.min(F.when(F.col(ts) > stop, F.col(ts))).alias("_high"))
    return near.crossJoin(F.broadcast(edges)).where(inside | (F.col(ts) == F.col("_low")) | (F.col(ts) == F.col("_high"))).select(*df.columns)


def presence(catalog_rows: DataFrame, name: str = "name") -> DataFrame:
    """Which sources a set of catalog rows shows: any rows, and metrics (not log) rows."""
    return catalog_rows.agg(F.bool_or(F.col("rows") > 0).alias("any"), F.bool_or((F.col("rows") > 0) & ~F.col(name).startswith("log_")).alias("metrics"))
