"""Structured Streaming: following a recording while it grows.

State is kept per entity. A batch query can ask for the moment right before
over all entities; a stream can only know the entity's own last row, so a rate
is withheld when that row is older than `max_gap`, which is how an entity that
was absent from a moment shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeloom.functions.timeutil import ts_us


def follow(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Rows of Parquet files as they appear in a folder; the checkpoint of the query holds what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucketed(rows: DataFrame, by: list[str], value: str, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts, sums and maxima per tumbling window; windows close `late` after the newest time seen."""
    timed = rows.withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total", "most")


class LastRows(StatefulProcessor):
    """Rates against each entity's row before. The last row is the state, and it expires when its entity is silent."""

    def __init__(self, max_gap: int, ttl_ms: int):
        self.max_gap, self.ttl_ms = max_gap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long, value double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable", ignore_index=True)
        ts, value = frame["ts"].to_numpy(np.int64), frame["value"].to_numpy(float)
        if self.last.exists():
            at, v = self.last.get()
            ts, value = np.concatenate([[at], ts]), np.concatenate([[v], value])
        else:
            ts, value = np.concatenate([ts[:1], ts]), np.concatenate([[np.nan], value])  # the first row has nothing before it
        # The row before is the latest of all seen so far, so rows that come late have none and replace none.
        best = np.maximum.accumulate(ts)
        holder = np.maximum.accumulate(np.where(np.concatenate([[True], ts[1:] > best[:-1]]), np.arange(len(ts)), 0))
        if np.isnan(value[0]):
            holder[1:] = np.maximum(holder[1:], 1)
        before = holder[:-1]
        gap, grown = ts[1:] - ts[before], value[1:] - value[before]
        with np.errstate(invalid="ignore"):
            known = (gap > 0) & (gap <= self.max_gap) & (grown >= 0)
        rate = np.where(known, grown / np.where(gap > 0, gap, 1) * 1e6, np.nan)
        self.last.update((int(ts[holder[-1]]), float(value[holder[-1]])))
        yield pd.DataFrame({"entity": [key[0]] * len(frame), "ts": frame["ts"], "rate": pd.array(np.where(known, rate, None), dtype="Float64")})

    def close(self) -> None:
        pass


def rates(rows: DataFrame, entity: str, value: str, max_gap: int, ts: str = "ts", forget_after: float | None = None) -> DataFrame:
    """(entity, ts, rate): a counter's rate against the entity's row before, across batches.

    rows: entity, ts in microseconds, value. Only the last row per entity is
    state, in RocksDB, and one that was not replaced for `forget_after` seconds
    (three times max_gap if not given) is forgotten, so entities that are gone
    leave nothing behind. Rows that arrive after a later one of their entity
    have no rate and do not replace it; a counter that fell has none either.
    Batches without data let state expire, without end: a query that should
    work off what is there and stop needs
    spark.sql.streaming.noDataMicroBatches.enabled = false.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema[entity].dataType.simpleString()
    named = rows.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    ttl = max(1, int(1_000 * (3 * max_gap / 1_000_000 if forget_after is None else forget_after)))
    return named.groupBy("entity").transformWithStateInPandas(LastRows(max_gap, ttl), f"entity {kind}, ts long, rate double", "append", "ProcessingTime")


class Tail:
    """What a growing recording holds behind a position (ts, key), in order; the position is a row in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, order: list[str]):
        self.spark, self.folder, self.order = spark, folder, order

    def position(self) -> tuple | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return tuple(self.spark.read.parquet(self.folder).first())

    def read(self, rows: DataFrame) -> DataFrame:
        """Rows behind the position, as a range that reaches the scan. An error if the recording ends before it, as one that was cut or replaced does."""
        at = self.position()
        if at is None:
            return rows
        key = lambda names: F.struct(*names)
        mark = key([F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(self.order, at)])
        newest = rows.where(F.col(self.order[0]) >= at[0]).agg(F.max(key(self.order)).alias("m")).first()["m"]
        if newest is None or tuple(newest) < at:
            raise ValueError(f"the recording ends before the position {at}")
        return rows.where((F.col(self.order[0]) >= at[0]) & (key(self.order) > mark))

    def advance(self, seen: DataFrame) -> tuple | None:
        """Moves the position to the last of the rows that were read; it never goes back."""
        newest = seen.agg(F.max(F.struct(*self.order)).alias("m")).first()["m"]
        if newest is None:
            return self.position()
        at = self.position()
        if at is not None and tuple(newest) < at:
            raise ValueError(f"{tuple(newest)} comes before the position {at}")
        self.spark.createDataFrame([tuple(newest)], seen.select(*self.order).schema).coalesce(1).write.mode("overwrite").parquet(self.folder)
        return tuple(newest)


def findings(rows: DataFrame, detector: str, condition: str, entity: str, ts: str = "ts") -> DataFrame:
    """Rows that meet a threshold, as they arrive; no state."""
    return rows.where(condition).select(F.lit(detector).alias("detector"), F.col(entity).cast("string").alias("entity"), ts_us(ts).alias("ts"))


def store(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Appends to Parquet exactly once; without `every`, what is there now is worked off and the query ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
