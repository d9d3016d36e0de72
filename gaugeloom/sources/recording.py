"""Recordings on disk: a table per layout, partitioned by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeloom.sources.layouts import Layout


def write(df: DataFrame, layout: Layout, root: str, segment: str = "segment_id", mode: str = "append") -> None:
    """Adds rows in the layout's order, a directory per segment, zstd-compressed.

    Rows go to their segment's partition and are sorted there by the sort key
    and then by all other columns; row groups thus have narrow key ranges.
    """
    names = [f.name for f in layout.schema.fields]
    rest = [n for n in names if n not in layout.sort_key]
    dealt = df.select(segment, *names).repartition(segment, F.spark_partition_id() % 4)  # a large segment is written by four tasks
    dealt.sortWithinPartitions(segment, *layout.sort_key, *rest).write.mode(mode).partitionBy(segment).option("compression", "zstd").parquet(f"{root}/type_id={layout.type_id}")


def read(spark: SparkSession, layout: Layout, root: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A layout's rows, with segment_id, from start up to stop; segments and row groups outside are not read."""
    schema = layout.schema.add("segment_id", "long")
    rows = spark.read.schema(schema).parquet(f"{root}/type_id={layout.type_id}")
    if stop is not None:
        rows = rows.where((F.col("ts") < stop) & (F.col("segment_id") < stop))
    return rows if start is None else rows.where(F.col("ts") >= start)


def segments(df: DataFrame, type_id: int) -> DataFrame:
    """segment_id, type_id, rows, min_ts, max_ts of the rows of a layout."""
    return df.groupBy("segment_id").agg(F.lit(type_id).alias("type_id"), F.count(F.lit(1)).alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def with_predecessors(catalog: DataFrame, start: int, stop: int) -> DataFrame:
    """Catalog rows that overlap [start, stop), and of every layout the nearest earlier segment, marked as such."""
    inside = catalog.where((F.col("max_ts") >= start) & (F.col("min_ts") < stop)).withColumn("predecessor", F.lit(False))
    names = catalog.columns
    before = catalog.where(F.col("max_ts") < start).groupBy("type_id").agg(F.max_by(F.struct(*names), F.struct("max_ts", "segment_id")).alias("x"))
    return inside.unionByName(before.select(*[F.col(f"x.{n}").alias(n) for n in names], F.lit(True).alias("predecessor")))


def inspect(catalog: DataFrame) -> DataFrame:
    """Rows and segments of each layout."""
    return catalog.groupBy("type_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def json_lines(df: DataFrame, path: str) -> None:
    """Writes rows as JSON, one per line."""
    df.write.mode("overwrite").json(path)


def dictionary(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Distinct texts of a column, of those that begin with `prefix`; the condition reaches the scan."""
    rows = df if prefix is None else df.where(F.col(column).startswith(prefix))
    return rows.select(column).distinct()


def blob(text: str, most: int = 1 << 20):
    """A long text as stored part, full length in bytes, whether it was cut, and the digest of the whole."""
    c = F.col(text)
    return F.struct(F.substring(F.encode(c, "UTF-8"), 1, most).alias("stored"), F.octet_length(c).alias("full_len"), (F.octet_length(c) > most).alias("truncated"), F.sha2(c, 256).alias("sha256"))


def retention(catalog: DataFrame, keep_bytes: int, size: str = "bytes") -> DataFrame:
    """Segments to drop, oldest first, so that the newest that fit in `keep_bytes` stay."""
    newest = Window.orderBy(F.desc("segment_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per segment
    sizes = catalog.groupBy("segment_id").agg(F.sum(size).alias("_b"))
    return sizes.withColumn("_upto", F.sum("_b").over(newest)).where(F.col("_upto") > keep_bytes).select("segment_id")
