"""K-d tree sharding of a corpus by its metadata.

The tree starts with all documents and splits a node at the weighted quantile
of its widest metadata dimension until every leaf holds its share of the bytes.
Quantiles are found by two distributed histograms: bytes by key prefix, then by
key inside the prefix that the cut falls into. Equal texts share the keys'
hashes; a third histogram, by hash of doc_id, cuts a key whose texts are too
heavy for either side. Only the cuts, fewer than there are shards, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.llm import store

DIMENSIONS = ("source", "lang", "size")
CELL_BITS, TIE_BITS, STEP_BITS = 14, 20, 17
ROW_OVERHEAD = 16
SLOT_ROWS = 50_000
TOLERANCE = 0.002  # of the bytes wanted on a side: what a cut between keys may be off by before it goes through a key


@dataclass(frozen=True)
class Cut:
    """Documents go left, to node 2n, if their key is below `at`, or is `at` and their id hash at most `upto`; the others to 2n + 1."""

    dimension: str
    at: int
    upto: int


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie, and for each dimension u_* in [0, 1] and k_*, a key.

    Text dimensions use their checksum, so equal values stay together. Null
    values are 0. A key is the cell of the value followed by a hash of the text:
    a value that holds a third of all rows can still be cut, and equal texts of
    equal metadata are not told apart. tie is a hash of doc_id for what must be.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_OVERHEAD
    base = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.pmod(F.xxhash64(F.lit(3), F.coalesce("text", F.lit(""))), F.lit(2**TIE_BITS)).alias("_text"), *[(F.crc32(F.coalesce(c, F.lit(""))) / F.lit(2.0**32)).alias(f"u_{c}") for c in ("source", "lang")])
    base = base.withColumn("u_size", F.least(F.lit(1.0), F.log2("size") / 40))
    cell = lambda d: F.least(F.lit(2**CELL_BITS - 1), F.floor(F.col(d) * 2**CELL_BITS)).cast("long")
    base = base.withColumn("tie", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2**STEP_BITS)))
    return base.select("*", *[(cell(f"u_{d}") * 2**TIE_BITS + F.col("_text")).alias(f"k_{d}") for d in DIMENSIONS]).drop("_text")


def node_of(cuts: dict[int, Cut], at: int = 1) -> Column:
    """The node a row falls into under the cuts so far."""
    if at not in cuts:
        return F.lit(at)
    cut, key = cuts[at], F.col(f"k_{cuts[at].dimension}")
    return F.when((key < cut.at) | ((key == cut.at) & (F.col("tie") <= cut.upto)), node_of(cuts, 2 * at)).otherwise(node_of(cuts, 2 * at + 1))


def _facts(meta: DataFrame, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of one row per node or leaf, so of fewer rows than twice the shards, for broadcasting."""
    return F.broadcast(meta.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in rows)} AS t({columns})"))


def _cross(meta: DataFrame, cuts: dict[int, Cut], dims: dict[int, str], wanted: dict[int, float], level: int, found: dict[int, tuple]) -> dict[int, tuple[int, int, int]]:
    """By node: the histogram bin that the wanted bytes fall into, the bytes before it, and with it.

    The bins are key prefixes (level 0), keys of the prefix found (1), or id
    hashes of the key found (2), at most 2 ** STEP_BITS of a node.
    """
    facts = _facts(meta, "node, dim, inside, before, wanted", [(n, DIMENSIONS.index(d), *found.get(n, (-1, 0))[:2], float(wanted[n])) for n, d in dims.items()])
    nodes = meta.withColumn("node", node_of(cuts)).join(facts, "node")
    nodes = nodes.withColumn("key", F.get(F.array(*[f"k_{d}" for d in DIMENSIONS]), F.col("dim")))
    prefix = F.shiftright("key", STEP_BITS)
    if level:
        nodes = nodes.where((prefix if level == 1 else F.col("key")) == F.col("inside"))
    weights = nodes.withColumn("bin", (prefix, F.col("key"), F.col("tie"))[level]).groupBy("node", "bin", "before", "wanted").agg(F.sum("size").alias("w"))
    run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = weights.withColumn("upto", F.sum("w").over(run) + F.col("before")).where("upto >= wanted")
    rows = hit.groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("x")).collect()  # a row per node, fewer than shards
    return {r["node"]: (r["x"]["bin"], r["x"]["upto"] - r["x"]["w"], r["x"]["upto"]) for r in rows}


def grow_tree(meta: DataFrame, shards: int) -> tuple[dict[int, Cut], dict[int, int]]:
    """The cuts, and the shard of each leaf."""
    cuts: dict[int, Cut] = {}
    leaves, open_nodes, out = {1: shards}, {1: shards} if shards > 1 else {}, {}
    while open_nodes:
        wide = meta.withColumn("node", node_of(cuts)).where(F.col("node").isin(list(open_nodes))).groupBy("node")
        spans = {r["node"]: r for r in wide.agg(F.sum("size").alias("w"), *[(F.max(f"u_{d}") - F.min(f"u_{d}")).alias(d) for d in DIMENSIONS]).collect()}
        dims = {n: max(DIMENSIONS, key=lambda d, n=n: spans[n][d]) if n in spans else DIMENSIONS[-1] for n in open_nodes}
        live = {n: d for n, d in dims.items() if n in spans}
        wanted = {n: spans[n]["w"] * (open_nodes[n] // 2) / open_nodes[n] for n in live}
        coarse = _cross(meta, cuts, live, wanted, 0, {}) if live else {}
        fine = _cross(meta, cuts, live, wanted, 1, coarse) if live else {}
        heavy = {n: live[n] for n, (_, low, high) in fine.items() if min(high - wanted[n], wanted[n] - low) > TOLERANCE * wanted[n]}
        ties = _cross(meta, cuts, heavy, wanted, 2, fine) if heavy else {}
        new = {}
        for n, k in open_nodes.items():
            at, low, high = fine.get(n, (-1, 0, 0))
            upto = -1 if n not in fine or wanted[n] - low < high - wanted[n] else 2**STEP_BITS
            if n in ties:
                tie, low, high = ties[n]
                upto = tie - (wanted[n] - low < high - wanted[n])
            cuts[n] = Cut(dims[n], at, upto)
            leaves.pop(n)
            leaves |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
            new |= {m: leaves[m] for m in (2 * n, 2 * n + 1) if leaves[m] > 1}
        open_nodes = new
    for i, n in enumerate(sorted(leaves, key=lambda n: f"{n:b}")):
        out[n] = i
    return cuts, out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law `bytes`.

    Slots number a shard's documents from 0, by doc_id inside hash parts of the
    shard, so no task orders a whole shard. Equal texts of equal source and lang
    share a shard, unless a cut that keeps them together would be off by more
    than TOLERANCE. Repeated rows are documents of their own and are never told
    apart; ties of the metadata are cut by the text's hash; null texts weigh the
    overhead alone; other columns are ignored; an empty table stays empty.
    """
    meta = store.written(metadata(docs), "kd-meta")
    cuts, shard = grow_tree(meta, shards)
    leaves = _facts(meta, "node, shard", list(shard.items()))
    placed = meta.withColumn("node", node_of(cuts)).join(leaves, "node").select("doc_id", "size", "text_crc32", "shard")
    parts = max(1, -(-meta.count() // (shards * SLOT_ROWS // 4)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(9), "doc_id", "text_crc32"), F.lit(max(parts, 8))))
    sums = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1)
    return local.join(ahead, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
