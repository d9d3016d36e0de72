"""Computations along a sequence: statistics, integrals, episodes, changes, forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.operators import links


def statistics(df: DataFrame, by: list[str], value: str, ts: str = "ts") -> DataFrame:
    """min, max, last and nearest-rank p50, p90, p99 of each series."""
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    return df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, ts).alias("latest"), *ranks)


def integral(df: DataFrame, by: list[str], rate: str, ts: str = "ts") -> DataFrame:
    """The sum of rate times the time since the sample before, in units times seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.withColumn("_t", F.col(ts) - F.lag(ts).over(w)).groupBy(*by).agg((F.sum(F.col(rate) * F.col("_t")).cast("double") / 1_000_000).alias("integral"))


def episodes(df: DataFrame, by: list[str], interval: int, monotone: list[str], ts: str = "ts") -> DataFrame:
    """Rows with an episode number: a new one begins after 2.5 intervals of silence or when a monotone counter falls."""
    w = Window.partitionBy(*by).orderBy(ts)
    starts = (F.col(ts) - F.lag(ts).over(w)) * 2 > 5 * interval
    for c in monotone:
        starts = starts | (F.col(c) < F.lag(c).over(w))
    flagged = df.withColumn("_s", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn("episode", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_s")


def changes(df: DataFrame, by: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Rows whose value differs from that of the row before; null is a value of its own. First rows count."""
    w = Window.partitionBy(*by).orderBy(ts)
    first = F.row_number().over(w) == 1
    return df.withColumn("_c", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_c").drop("_c")


def forest(edges: DataFrame, child: str, parent: str, cycles: bool = False) -> DataFrame:
    """(node, root, level) of every node below roots. A root's parent is null, is itself, or is no node of the table.

    With `cycles`, the lowest node of each cycle is a root too, and every node
    is there; else members of cycles, and what hangs below them, are left out.
    Nodes are told apart by `child`: null is none, and of several parents the
    smallest counts. There is no limit of depth.
    """
    kind = edges.schema[child].dataType
    nodes = edges.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(F.col(parent).try_cast(kind)).alias("up"))
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    up = F.when(F.col("_known") & (F.col("up") != F.col("node")), F.col("up"))
    return links.roots(links.joined(nodes, known, "up", "left").select("node", up.alias("up")), cycles)


def weighted_mean(value: str, weight: str):
    """Sum of value times weight by sum of weight."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)).cast("double"), F.sum(weight).cast("double"))
