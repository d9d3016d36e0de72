"""Walks up links from nodes to the one above, in rounds that double their reach.

Every round is written to the folder that driver and executors share, which
cuts the lineage, and has a row per node. The number of rounds grows as the
logarithm of the longest way; there is no limit of depth or rows.
Joins of these tables merge both sides (`joined`): they pack so well that Spark
takes millions of rows for a small table and would broadcast them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster, whose machines share none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/gaugeloom-{spark.sparkContext.applicationId}"
    return path.rstrip("/")


class Rounds:
    """Tables of one walk. What no result reads any more is deleted by dropped()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{_shared(spark)}/links-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        """`df` written once as Parquet and read back."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, upto: int) -> None:
        """Deletes the tables up to the number `upto`."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in range(1, upto + 1):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
            path.getFileSystem(conf).delete(path, True)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends neither side through the driver, however small its files are."""
    return left.hint("merge").join(right, on, how)


def _settled(links: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, at, level, ended) of links (node, up): `at` is the root of what has ended; what has not leads into a cycle.

    After k rounds all of less than 2 ** k levels have ended. A round that ends
    none finds no level above those, so only cycles are left.
    """
    root = F.col("up").isNull()
    state = rounds.written(links.select("node", F.coalesce("up", "node").alias("at"), F.when(root, 0).otherwise(1).alias("level"), root.alias("ended")))
    open_before, still = None, state.where("NOT ended").count()
    while still and still != open_before:
        above = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("level").alias("more"), F.col("ended").alias("top"))
        moved = joined(state.where("NOT ended").drop("ended"), above, "at").select("node", F.col("next").alias("at"), (F.col("level") + F.col("more")).alias("level"), F.col("top").alias("ended"))
        state = rounds.written(state.where("ended").unionByName(moved))
        open_before, still = still, state.where("NOT ended").count()
    return state


def _first_of_cycles(links: DataFrame, rounds: Rounds) -> DataFrame:
    """node: the lowest of each cycle, of links (node, up) that all lead into cycles."""
    state = rounds.written(links.select("node", F.col("up").alias("at")))
    before, reached = None, state.select("at").distinct().count()
    while reached != before:  # the places reached are fewer each round until they are the cycles' members
        state = rounds.written(joined(state, state.select(F.col("node").alias("at"), F.col("at").alias("next")), "at").select("node", F.col("next").alias("at")))
        before, reached = reached, state.select("at").distinct().count()
    members = state.select(F.col("at").alias("node")).distinct()
    state = rounds.written(joined(links, members, "node", "left_semi").select("node", F.col("up").alias("at"), F.col("node").alias("least"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("offer"))
        state = rounds.written(joined(state.drop("moved"), ahead, "at").select("node", F.col("next").alias("at"), F.least("least", "offer").alias("least"), (F.col("offer") < F.col("least")).alias("moved")))
    return state.where("node = least").select("node")


def roots(links: DataFrame, cycles: bool = True) -> DataFrame:
    """(node, root, level) of links (node, up), where `up` is null or a node, and each node has one row.

    The lowest node of a cycle is a root; without `cycles`, what leads into one is left out.
    """
    rounds = Rounds(links.sparkSession)
    links = rounds.written(links.select("node", "up"))
    state = _settled(links, rounds)
    done, stuck = state.where("ended"), state.where("NOT ended").select("node")
    if cycles and not stuck.isEmpty():
        held = rounds.written(joined(links, stuck, "node", "left_semi"))
        firsts = _first_of_cycles(held, rounds).withColumn("_first", F.lit(True))
        cut = joined(held, firsts, "node", "left").select("node", F.when(F.col("_first").isNull(), F.col("up")).alias("up"))
        done = done.unionByName(_settled(cut, rounds))
    out = rounds.written(done.select("node", F.col("at").alias("root"), "level"))
    rounds.dropped(rounds.n - 1)
    return out


def upward(links: DataFrame, marked: DataFrame) -> DataFrame:
    """node: all of `marked` (node), and all above them by links (node, up).

    The reach of links doubles each round while every node has one above; if
    some have several, rounds go level by level.
    """
    rounds = Rounds(links.sparkSession)
    steps = rounds.written(links.where("node IS NOT NULL AND up IS NOT NULL").select("node", "up").distinct())
    single = steps.groupBy("node").count().where("count > 1").isEmpty()
    kept = rounds.written(marked.where("node IS NOT NULL").select("node").distinct())
    while True:
        new = rounds.written(joined(joined(kept, steps, "node").select(F.col("up").alias("node")).distinct(), kept, "node", "left_anti"))
        if new.isEmpty():
            break
        kept = rounds.written(kept.unionByName(new))
        if single:
            steps = rounds.written(joined(steps, steps.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
    out = rounds.written(kept)
    rounds.dropped(rounds.n - 1)
    return out


def components(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, label) of pairs (a, b): the smallest node that pairs reach, whichever way they point.

    Labels hook to smaller ones across pairs and are then looked up in each
    other, so rounds grow as the logarithm of the longest way.
    """
    both = rounds.written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = rounds.written(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("label"), F.lit(True).alias("moved")))
    while not state.where("moved").isEmpty():
        own, other = state.select(F.col("node").alias("a"), F.col("label").alias("own")), state.select(F.col("node").alias("b"), F.col("label").alias("to"))
        lower = joined(joined(both, own, "a"), other, "b").where("to < own")
        offers = lower.select("a", "to").union(lower.select("own", "to")).groupBy("a").agg(F.min("to").alias("offer")).withColumnRenamed("a", "node")
        hooked = joined(state.select("node", F.col("label").alias("was")), offers, "node", "left").withColumn("label", F.least("was", F.coalesce("offer", "was")))
        ahead = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        state = rounds.written(joined(hooked, ahead, "label", "left").select("node", F.coalesce("next", "label").alias("label"), (F.coalesce("next", "label") != F.col("was")).alias("moved")))
    return state.select("node", "label")


def first_paths(starts: DataFrame, steps: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, path): of all ways from starts (node, path) down steps (up, node, name), the one whose path of names comes first.

    That is the way on which a walk that takes the smaller name first, and no
    node twice, meets the node. Only what got a better path in a round goes on
    in the next one; paths pass no name twice, so cycles end.
    """
    best = fresh = rounds.written(starts.select("node", "path"))
    while True:
        onward = joined(fresh.withColumnRenamed("node", "up"), steps, "up").where(~F.array_contains("path", F.col("name")))
        offers = onward.groupBy("node").agg(F.min(F.concat("path", F.array("name"))).alias("offer"))
        fresh = rounds.written(joined(offers, best, "node", "left").where(F.col("path").isNull() | (F.col("offer") < F.col("path"))).select("node", F.col("offer").alias("path")))
        if fresh.isEmpty():
            return best
        best = rounds.written(joined(best, fresh.select("node"), "node", "left_anti").unionByName(fresh))
