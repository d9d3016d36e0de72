"""Connected components of a table of links, without collecting them anywhere.

Every node starts as its own label. Each round hooks labels to smaller ones
across links, lets nodes take them over, and shortens the way from a node to
the label of its label, so the number of rounds grows as the logarithm of the
longest path. Rounds are written to shared storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the smallest node that can be reached, for every node with a link."""
    both = store.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = store.written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"), F.lit(True).alias("moved")), "labels")
    moved = True
    while moved:  # labels only fall, so this ends
        of = labels.select("node", "label")
        ends = both.join(of.withColumnRenamed("node", "b").withColumnRenamed("label", "to"), "b").join(of.withColumnRenamed("node", "a").withColumnRenamed("label", "own"), "a")
        offers = ends.where("to < own").select(F.explode(F.array("a", "own")).alias("node"), "to").groupBy("node").agg(F.min("to").alias("offer"))
        hooked = of.join(offers, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        far = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = store.written(hooked.join(far, "label", "left").select("node", F.coalesce("next", "label").alias("label"), (F.coalesce("next", "label") != F.col("was")).alias("moved")), "labels")
        moved = not labels.where("moved").isEmpty()
    return labels.select("node", "label")
