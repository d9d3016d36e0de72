"""Trees of control groups and layers of block devices: what is left after children, chains, and who is charged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.functions.counters import adjacent
from gaugeloom.operators import links


def with_parent(df: DataFrame, path: str = "path") -> DataFrame:
    """Rows with parent_path: the path without its last part; '/' for a part right below the root, null for the root itself."""
    plain = F.when(F.col(path) == "/", F.col(path)).otherwise(F.rtrim(F.col(path), F.lit("/")))
    above = F.regexp_replace(plain, "/[^/]*$", "")
    return df.withColumn(path, plain).withColumn("parent_path", F.when(plain != "/", F.when(above == "", "/").otherwise(above)))


def residuals(df: DataFrame, by: list[str], fields: list[str], path: str = "path") -> DataFrame:
    """by..., path, children, and for each field its value and <field>_own: what of it no child group accounts for.

    Children are the groups right below in the same row set of `by`, as a
    moment. What is left is unknown if the group's value is unknown, or one of
    its children's; it is no less than 0, since children are read later than
    their parent. A child whose parent is not recorded adds to nothing.
    """
    rows = with_parent(df, path)
    sums = [F.sum(f).alias(f"_s_{f}") for f in fields] + [F.count_if(F.col(f).isNull()).alias(f"_u_{f}") for f in fields]
    below = rows.where("parent_path IS NOT NULL").groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col("parent_path").alias("_parent")).agg(F.count(F.lit(1)).alias("children"), *sums)
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(path) == F.col("_parent")]
    out = rows.join(below, same, "left")
    own = [F.when(F.coalesce(F.col(f"_u_{f}"), F.lit(0)) == 0, F.greatest(F.col(f) - F.coalesce(f"_s_{f}", F.lit(0)), F.lit(0))) for f in fields]
    left = [F.when(F.col(f).isNotNull(), o).alias(f"{f}_own") for f, o in zip(fields, own)]
    return out.select(*by, path, F.coalesce("children", F.lit(0)).cast("long").alias("children"), *fields, *left)


def device_names(devices: DataFrame, device: str = "device", name: str = "name") -> DataFrame:
    """(device, name): the one name of a device; a device with two names has none."""
    known = devices.where(F.col(device).isNotNull() & F.col(name).isNotNull())
    return known.groupBy(device).agg(F.when(F.min(name) == F.max(name), F.min(name)).alias(name))


def device_rates(df: DataFrame, by: list[str], counters: list[str], ts: str = "ts") -> DataFrame:
    """by..., ts and for each counter <counter>_rate, per second against the device's row before; unknown where it fell."""
    out = df
    for c in counters:
        out = adjacent(out.select(*df.columns, *[x for x in out.columns if x.endswith("_rate")]), by, c, ts).withColumnRenamed("rate", f"{c}_rate")
    return out.select(*by, ts, *[f"{c}_rate" for c in counters])


def layers(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(device, chain): from each device down the smallest device beneath it, layer by layer, until none is beneath or one comes again.

    Chains double in length each round; edges without either end are left out.
    """
    rounds = links.Rounds(edges.sparkSession)
    known = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("device"), F.col(parent).alias("below"))
    first = known.groupBy("device").agg(F.min("below").alias("below"))
    every = known.select("device").union(known.select("below")).distinct()
    state = rounds.written(links.joined(every, first, "device", "left").select("device", F.filter(F.array("device", "below"), lambda x: x.isNotNull()).alias("chain"), F.col("below").alias("at")))
    while not state.where("at IS NOT NULL").isEmpty():
        ahead = state.select(F.col("device").alias("at"), F.col("chain").alias("more"), F.col("at").alias("next"))
        joined = links.joined(state, ahead, "at", "left")
        whole = F.concat("chain", F.slice("more", 2, F.greatest(F.size("more") - 1, F.lit(0))))
        again = F.size(F.array_distinct(whole)) < F.size(whole)  # a ring: up to where it begins anew
        upto = F.aggregate(whole, F.array().cast(state.schema["chain"].dataType), lambda seen, x: F.when(F.array_contains(seen, x), seen).otherwise(F.concat(seen, F.array(x))))
        chain = F.when(F.col("at").isNull(), F.col("chain")).when(again, upto).otherwise(whole)
        state = rounds.written(joined.select("device", chain.alias("chain"), F.when(F.col("at").isNotNull() & ~again, F.col("next")).alias("at")))
    return state.select("device", "chain")


def charged_layers(edges: DataFrame, charged: DataFrame, child: str = "child", parent: str = "parent", device: str = "device") -> DataFrame:
    """(device, folded_into): for each charged device the nearest charged layer on top of it, the smallest of several; null if there is none.

    Ways end at charged devices, so a layer counts for those right below it only.
    """
    rounds = links.Rounds(edges.sparkSession)
    marks = rounds.written(charged.where(F.col(device).isNotNull()).select(F.col(device).alias("device")).distinct())
    up = rounds.written(edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent))).select(F.col(parent).alias("at"), F.col(child).alias("above")).distinct())
    reached = rounds.written(marks.select("device", F.col("device").alias("at")))
    seen, found = reached, None
    while not reached.isEmpty():
        step = links.joined(links.joined(reached, up, "at").select("device", F.col("above").alias("at")).where(F.col("at") != F.col("device")).distinct(), seen, ["device", "at"], "left_anti")
        step = rounds.written(links.joined(step, marks.select(F.col("device").alias("at"), F.lit(True).alias("hit")), "at", "left"))
        hits = step.where("hit").select("device", F.col("at").alias("folded_into"))
        found = rounds.written(hits if found is None else found.unionByName(hits))
        reached = rounds.written(step.where("hit IS NULL").select("device", "at"))
        seen = rounds.written(seen.unionByName(step.select("device", "at")))
    best = (found if found is not None else marks.withColumn("folded_into", F.lit(None).cast(marks.schema["device"].dataType))).groupBy("device").agg(F.min("folded_into").alias("folded_into"))
    return links.joined(marks, best, "device", "left")
