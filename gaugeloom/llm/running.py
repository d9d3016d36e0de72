"""Numbers and running sums over all rows of a table, in one order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.llm import store


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """`df` with, for every entry of `sums`, the sum of that column over the rows before each row in `order`.

    Rows are range-partitioned by `order` and written; the sums of whole ranges
    (one row per range) are added up and broadcast, and inside a range a window
    does the rest. Rows that are equal in `order` share a range, so `order`
    should tell all rows apart that differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = store.written(df.repartitionByRange(n, *order).withColumns({"_range": F.spark_partition_id()} | {f"_{k}": v.cast("long") for k, v in sums.items()}), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = laid.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums}).join(F.broadcast(ranges), "_range")
    return got.select(*df.columns, *[(F.col(k) + F.col(f"_{k}_before")).alias(k) for k in sums])
