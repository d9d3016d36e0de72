"""Series blocks: what a recording's segments amount to over time, kept beside it and built for new segments only.

A block is the points of one series in one segment. A segment's counters need
the moment before its first one: the last moment of every segment is kept as a
seed, so a new segment is built from its own rows and its predecessor's seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.functions.counters import predecessor, rate


@dataclass(frozen=True)
class Series:
    """A series over moments: the maximum or sum of a gauge, or the sum of a counter's rates, over the entities of a moment."""

    name: str
    column: str
    kind: str  # "max", "sum" or "rate"


class Index:
    """The blocks of a recording with rows (segment_id, ts, entity..., values), in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str, entity: list[str], series: list[Series], ts: str = "ts"):
        self.spark, self.root, self.entity, self.series, self.ts = spark, root.rstrip("/"), entity, series, ts
        self.counters = sorted({s.column for s in series if s.kind == "rate"})

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def built(self) -> DataFrame | None:
        """segment_id, last_ts of the segments that have blocks; None if there are none yet."""
        return self.spark.read.parquet(f"{self.root}/segments") if self._exists(f"{self.root}/segments/_SUCCESS") else None

    def refresh(self, rows: DataFrame) -> int:
        """Builds the blocks of segments that have none, and returns their number. Segments are built once and never change.

        Only rows of new segments are read, and the seeds of the segments that
        come right before one of them. A list of segments, a row each, is
        collected. Seeds and blocks are written before the list of segments, so a
        run that breaks off leaves nothing that counts.
        """
        catalog = rows.groupBy("segment_id").agg(F.max(self.ts).alias("last_ts"))
        done = self.built()
        new = catalog if done is None else catalog.join(done.select("segment_id"), "segment_id", "left_anti")
        fresh = {r["segment_id"]: r["last_ts"] for r in new.collect()}
        if not fresh:
            return 0
        old = [] if done is None else sorted(r["segment_id"] for r in done.select("segment_id").collect())
        own = rows.where(F.col("segment_id").isin(list(fresh)))
        before = {max((s for s in old if s < f), default=None) for f in fresh} - {None}
        self.points(own, self.seeds(list(before)) if before else None).write.mode("append").partitionBy("segment_id").parquet(f"{self.root}/blocks")
        last = F.broadcast(self.spark.createDataFrame(list(fresh.items()), rows.select("segment_id", F.col(self.ts).alias("_last")).schema))
        kept = own.join(last, "segment_id").where(F.col(self.ts) == F.col("_last")).select("segment_id", self.ts, *self.entity, *self.counters)
        kept.write.mode("append").partitionBy("segment_id").parquet(f"{self.root}/seeds")
        self.spark.createDataFrame(list(fresh.items()), new.schema).coalesce(1).write.mode("append").parquet(f"{self.root}/segments")
        return len(fresh)

    def seeds(self, segments: list) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/seeds").where(F.col("segment_id").isin(segments))

    def points(self, rows: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
        """segment_id, series, from_ts, to_ts, points, checksum: the blocks of all segments in `rows`."""
        ts, need = self.ts, sorted({s.column for s in self.series})
        every = rows.select("segment_id", ts, *self.entity, *need, F.lit(False).alias("_seed"))
        if seeds is not None:
            every = every.unionByName(seeds.select("segment_id", ts, *self.entity, *self.counters, F.lit(True).alias("_seed")), allowMissingColumns=True)
        if self.counters:
            every = predecessor(every, self.entity, self.counters, ts)
        known = every.where(~F.col("_seed"))
        made = {"max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "rate": lambda c: F.sum(rate(F.col(f"prev_{c}"), F.col(c), F.col("prev_ts"), F.col(ts)))}
        moments = known.groupBy("segment_id", ts).agg(*[made[s.kind](s.column).cast("double").alias(s.name) for s in self.series])
        pairs = F.explode(F.array(*[F.struct(F.lit(s.name).alias("series"), F.col(s.name).alias("value")) for s in self.series])).alias("x")
        points = moments.select("segment_id", ts, pairs).where("x.value IS NOT NULL")
        blocks = points.groupBy("segment_id", "x.series").agg(F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"), F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col("x.value").alias("value")))).alias("points"))
        return blocks.withColumn("checksum", checksum())

    def load(self, series: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
        """segment_id, series, ts, value of the points in [start, stop); fails on a block whose checksum is not its own. Other segments' files are not read."""
        blocks = self.spark.read.parquet(f"{self.root}/blocks").join(F.broadcast(self.built().select("segment_id").distinct()), "segment_id", "left_semi")
        blocks = blocks if series is None else blocks.where(F.col("series") == series)
        blocks = blocks if start is None else blocks.where(F.col("to_ts") >= start)
        blocks = blocks if stop is None else blocks.where(F.col("from_ts") < stop)
        sound = F.when(F.col("checksum") == checksum(), F.lit(True)).otherwise(F.raise_error(F.lit("a block's checksum is not its own")).cast("boolean"))
        points = blocks.where(sound).select("segment_id", "series", F.explode("points").alias("p")).select("segment_id", "series", "p.ts", "p.value")
        points = points if start is None else points.where(F.col("ts") >= start)
        return points if stop is None else points.where(F.col("ts") < stop)


def checksum():
    """CRC-32 of a block's points as JSON."""
    return F.crc32(F.to_json("points"))
