"""N-gram Jaccard join by vertical partitioning of the n-gram order.

First, n-grams are dealt by the leading bits of their hashes. Every part of the
hash space is one group, so it alone can tell how many texts hold its n-grams.
N-grams of one text can't add to any overlap, and a text whose shared n-grams
are too few to reach the threshold has no partner; what is left is a small
share of the corpus.

The other n-grams are ordered by how many texts hold them, then by hash, and
that order is cut into FRAGMENTS contiguous fragments of about equal weight.
Candidate pairs meet in a prefix of the order. Their partial overlaps are
counted fragment by fragment, from the rarest n-grams on, and summed; a pair
goes as soon as what is left of either text can't lift it to the threshold.

Equal sets are one node from the start. Candidates first go only between a
node and one leader per prefix n-gram; the links found so far make clusters,
and then just the pairs across clusters are left to be looked at. So a group of
thousands of near copies costs a few pairs per member, and no link between
different clusters is lost.

N-grams are known by whole 63-bit hashes, sets by 64-bit ones: of n different
n-grams any two are taken for equal with a chance of about n * n / 2 ** 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.components import components
from gaugeloom.llm.memory import give_back, small_batches, tidy
from gaugeloom.llm.words import mix, word_hashes

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
HOT_GRAMS, HOT_PARTS = 100_000, 8  # n-grams that are broadcast as frequent, and the parts they make up
LOCAL_HOT = 2_048  # an n-gram is a candidate for that if it is in so great a part of a batch of texts (and in 8)
PART_GRAMS = 6_000_000
SLICE_BITS = 3  # a part is sorted in so many slices as these bits tell apart, to bound memory
SCAN_ROWS, DEAL_ROWS = 2_048, 1_024
FRAGMENTS = 4  # of the order, counted one after the other
HOT_RANK = 64
LEADERS, HOT_LEADERS, HOT_ROWS = 4, 20_000, 1_000  # at most so many leaders are broadcast, of n-grams with more than so many texts
CELL_TEXTS = 1_000  # texts of an n-gram that meet as many others in one cell
TURNS, FEW_MEETINGS, MEETINGS = 8, 20_000, 0.5  # at most so many turns of more leaders, while more than so many pairs are left across clusters, or per prefix n-gram
GRAM_BITS = 63  # n-grams are non-negative longs; negative ones stand for hot n-grams
_STEPS = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]


def gram_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram as a whole."""
    out = []
    for h in word_hashes(texts):
        k = min(width, len(h))
        if not k:
            out.append(h)
            continue
        g = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            g += h[i : i + len(g)] * _STEPS[i + 1]
        out.append(np.unique(mix(g) >> np.uint64(64 - GRAM_BITS)))
    return out


def set_key(grams: np.ndarray) -> int:
    """A hash of the set."""
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _needed(n, num: int, den: int):
    """The least overlap that a set of n can have with a partner."""
    return -(-n * num // den)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (doc_id, key, n, null) for every document; (null, n-gram, count, true) for n-grams common in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "hot"]
        for batch in (b.slice(i, SCAN_ROWS) for b in batches for i in range(0, b.num_rows, SCAN_ROWS)):
            sets = gram_sets(batch.column(1).to_pylist(), width)
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.bool_())], names=names)
            grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            grams.sort()
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([first, [len(grams)]]))
            common = count >= max(8, batch.num_rows // LOCAL_HOT)
            g, c = grams[first[common]].view(np.int64), count[common]
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(g), batch.column(0).type), pa.array(g), pa.array(c.astype(np.int64)), pa.array(np.ones(len(g), bool))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, key long, n long, hot boolean")


def _hot(scan: DataFrame) -> np.ndarray:
    """The most frequent of the n-grams that a batch found common, HOT_GRAMS at most, in order of their hashes."""
    counted = store.written(scan.where("hot").groupBy("key").agg(F.sum("n").alias("n")), "gram-hot")
    have = counted.count()
    if have > HOT_GRAMS:
        least = counted.agg(F.percentile_approx("n", 1 - HOT_GRAMS / have, 10_000)).first()[0]
        counted = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(HOT_GRAMS)
    return np.sort(np.array([r["key"] for r in counted.select("key").collect()], np.int64).view(np.uint64))


def _all_grams(column: pa.ChunkedArray) -> np.ndarray:
    """The n-grams of all rows in one array, decoded row by row."""
    out, at = np.empty(sum(pc.sum(pc.binary_length(c)).as_py() or 0 for c in column.chunks) // 8, np.uint64), 0
    for chunk in column.chunks:
        for value in chunk:
            part = np.frombuffer(value.as_py(), "<u8")
            out[at : at + len(part)] = part
            at += len(part)
    return out


def _deal(docs: DataFrame, hot: np.ndarray, part_bits: int, width: int) -> DataFrame:
    """Per batch and part of the hash space a row with what all its texts have there: keys, sizes, lengths, n-grams, and at home the hot ones."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    parts = 1 << part_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            sets = [s for s in gram_sets(batch.column(0).to_pylist(), width) if len(s)]
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets])
            keys = np.array([set_key(s) for s in sets], np.int64)
            keys, once = np.unique(keys, return_index=True)
            sets, sizes = [sets[i] for i in once], sizes[once]
            grams = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            place = np.minimum(np.searchsorted(hot, grams), max(len(hot) - 1, 0))
            is_hot = hot[place] == grams if len(hot) else np.zeros(len(grams), bool)
            hot_owner, hot_place = owner[is_hot], place[is_hot].astype("<i4")
            hot_begin = np.searchsorted(hot_owner, np.arange(len(sets) + 1))
            grams, owner = grams[~is_hot], owner[~is_hot]
            part_of = (grams >> np.uint64(GRAM_BITS - part_bits)).astype(np.int64)
            order = np.argsort(part_of, kind="stable")  # inside a part still by owner, then by n-gram
            grams, owner = grams[order], owner[order]
            begin = np.searchsorted(part_of[order], np.arange(parts + 1))
            home = keys & (parts - 1)
            for f in range(parts):
                a, b = begin[f], begin[f + 1]
                part = np.bincount(owner[a:b], minlength=len(sets))
                who = np.flatnonzero((part > 0) | (home == f))
                if not len(who):
                    continue
                hots = [hot_place[hot_begin[w] : hot_begin[w + 1]] if home[w] == f else hot_place[:0] for w in who]
                cols = [
                    pa.array([f], pa.int32()), pa.array([keys[who].tobytes()]), pa.array([sizes[who].astype("<i4").tobytes()]), pa.array([part[who].astype("<i4").tobytes()]),
                    pa.array([grams[a:b].astype("<u8").tobytes()]), pa.array([np.array([len(h) for h in hots], "<i4").tobytes()]), pa.array([np.concatenate(hots).tobytes()]),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "keys", "sizes", "parts", "grams", "hot_parts", "hot"])

    return docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "part int, keys binary, sizes binary, parts binary, grams binary, hot_parts binary, hot binary")


def _held_twice(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, gram, owners) of the n-grams that more than one text holds."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    runs = np.diff(np.concatenate([edge, [len(ordered)]]))
    held = np.repeat(runs, runs)
    use = held > 1
    return owner[order[use]], ordered[use], held[use]


def _shared(dealt: DataFrame, part_bits: int) -> DataFrame:
    """(key, n, part, grams, ranks): of what each text has in a part the n-grams that other texts hold too.

    An n-gram is its whole hash as a long; hot ones
    have negative numbers and parts of their own. Ranks order them: the number of texts that hold
    one, as a power of two; hot ones come last.
    """

    def run(table: pa.Table) -> pa.Table:
        col = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in table[n].to_pylist()])
        f = table["part"][0].as_py()
        keys, sizes, parts, hot_parts, hot = col("keys", np.int64), col("sizes", "<i4"), col("parts", "<i4"), col("hot_parts", "<i4"), col("hot", "<i4")
        grams = _all_grams(table["grams"])
        _, once = np.unique(keys, return_index=True)  # equal texts from other batches
        first = np.zeros(len(keys), bool)
        first[once] = True
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), parts)
        if not first.all():
            use = first[owner]
            grams, owner = grams[use], owner[use]
        slice_ = (grams >> np.uint64(GRAM_BITS - part_bits - SLICE_BITS)).astype(np.uint8) & ((1 << SLICE_BITS) - 1)
        found = [_held_twice(grams[part], owner[part]) for k in range(1 << SLICE_BITS) if len(part := np.flatnonzero(slice_ == k))]
        owner, grams, held = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        grams = grams.astype(np.int64)
        rank = np.ceil(np.log2(held)).astype(np.int32)
        hot_owner = np.repeat(np.arange(len(keys)), hot_parts)
        use = first[hot_owner]
        hot = hot[use]
        owner = np.concatenate([owner, hot_owner[use]])
        place = np.concatenate([np.full(len(grams), f), -1 - hot % HOT_PARTS])
        grams = np.concatenate([grams, -1 - hot.astype(np.int64)])
        rank = np.concatenate([rank, HOT_RANK + hot])
        order = np.lexsort((place, owner))
        owner, place, grams, rank = owner[order], place[order], grams[order], rank[order]
        begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])) if len(owner) else np.zeros(0, np.int64)
        ends = np.concatenate([begin, [len(owner)]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (grams, rank.astype(np.int32))]
        who = owner[begin]
        give_back()
        return pa.table([pa.array(keys[who]), pa.array(sizes[who].astype(np.int64)), pa.array(place[begin].astype(np.int32)), *lists], names=["key", "n", "part", "grams", "ranks"])

    return dealt.groupBy("part").applyInArrow(run, "key long, n long, part int, grams array<long>, ranks array<int>")


def _prefixes(whole: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, key, n, pos, alone): the n-grams one of which a text has in common with any partner, with their place in its order.

    alone counts the n-grams that no other text holds; they come before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                grams, ranks = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                alone = n - len(grams)  # these come first in the order and have no partner
                take = n - _needed(n, num, den) + 1 - alone
                if take > 0:
                    order = np.lexsort((grams, ranks))[:take]
                    for o, x in zip(out, (grams[order], np.full(len(order), key), np.full(len(order), n), alone + np.arange(len(order)), np.full(len(order), alone))):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["gram", "key", "n", "pos", "alone"])

    return whole.select("key", "n", "grams", "ranks").mapInArrow(tidy(run), "gram long, key long, n long, pos long, alone long")


def _cuts(whole: DataFrame) -> list[float]:
    """Places in the order, FRAGMENTS - 1 of them, between which there are about as many occurrences of n-grams.

    The whole part of a place is the rank, all hot n-grams being of one; behind
    the point is the share of the rank's hashes, or hot n-grams, that come before.
    """
    rows = whole.select(F.explode("ranks").alias("rank")).groupBy(F.least("rank", F.lit(HOT_RANK)).alias("rank")).count().orderBy("rank").collect()  # at most HOT_RANK + 1
    total, before, out = sum(r["count"] for r in rows), 0, []
    for r in rows:
        while len(out) < FRAGMENTS - 1 and before + r["count"] >= total * (len(out) + 1) / FRAGMENTS:
            out.append(r["rank"] + (total * (len(out) + 1) / FRAGMENTS - before) / r["count"])
        before += r["count"]
    return out


def _segments(whole: DataFrame, hot: int) -> DataFrame:
    """(key, fragment, grams, behind): a text's n-grams by contiguous fragments of the order, and how many come in later ones."""
    cuts = _cuts(whole)
    span = float(1 << GRAM_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SCAN_ROWS) for b in batches for i in range(0, b.num_rows, SCAN_ROWS)):
            lists: list[np.ndarray] = []
            behind: list[np.ndarray] = []
            for i in range(batch.num_rows):
                grams, ranks = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                is_hot = ranks >= HOT_RANK
                place = np.where(is_hot, HOT_RANK + (ranks - HOT_RANK) / max(hot, 1), ranks + grams / span)
                fragment = np.searchsorted(cuts, place, side="right")
                order = np.argsort(fragment, kind="stable")
                ends = np.searchsorted(fragment[order], np.arange(FRAGMENTS + 1))
                lists += [grams[order[ends[f] : ends[f + 1]]] for f in range(FRAGMENTS)]
                behind.append(len(grams) - ends[1:])
            if lists:
                upto = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column(0).to_numpy(), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), batch.num_rows)),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(lists))), pa.array(np.concatenate(behind).astype(np.int64)),
                ], names=["key", "fragment", "grams", "behind"])

    return whole.select("key", "grams", "ranks").mapInArrow(tidy(run), "key long, fragment int, grams array<long>, behind long")


def linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs (a, b, na, nb) that reach the threshold.

    The overlaps of one fragment after the other are added up; behind the last
    one, what is left is nothing, and the bound is the threshold itself.
    """
    live = pairs.withColumn("shared", F.lit(0).cast("long"))
    for f in range(FRAGMENTS):
        left, right = (segments.where(F.col("fragment") == f).select(F.col("key").alias(x), F.col("grams").alias(f"grams_{x}"), F.col("behind").alias(f"behind_{x}")) for x in "ab")
        most = F.col("shared") + F.least("behind_a", "behind_b")
        live = live.join(left, "a").join(right, "b").withColumn("shared", F.col("shared") + F.size(F.array_intersect("grams_a", "grams_b")))
        live = live.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b", "na", "nb", "shared")
    return live.select("a", "b")


def _pair(x: str, y: str, nx: str, ny: str) -> list:
    first = F.col(x) < F.col(y)
    return [F.when(first, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in ((x, y, "a"), (y, x, "b"), (nx, ny, "na"), (ny, nx, "nb"))]


def _with_leaders(rows: DataFrame, leaders: DataFrame, total: int) -> DataFrame:
    """rows joined with leaders(gram, ..., c) by gram.

    Those of n-grams with c over max(HOT_ROWS, total / HOT_LEADERS), so of fewer
    than HOT_LEADERS, are broadcast: no task gets all texts of a common n-gram.
    """
    leaders = store.written(leaders, "gram-leaders")
    limit = max(HOT_ROWS, total // HOT_LEADERS)
    hot = F.broadcast(leaders.where(F.col("c") > limit).drop("c"))
    cold = rows.join(F.broadcast(leaders.where(F.col("c") > limit).select("gram")), "gram", "left_anti")
    return rows.join(hot, "gram").unionByName(cold.join(leaders.where(F.col("c") <= limit).drop("c"), "gram"))


def _stars(prefixes: DataFrame, front: int, num: int, den: int) -> DataFrame:
    """Candidate pairs of a text and a few of the leaders of its prefix n-grams.

    A leader is the text with the smallest share of n-grams of its own, as the
    original has among its copies; a second one is any. So there are at most
    2 * LEADERS pairs per text.
    """
    ways = {"own": F.struct((F.col("alone") / F.col("n")).alias("o"), F.xxhash64("key").alias("h"), "key", "n"), "any": F.struct(F.lit(0.0).alias("o"), F.xxhash64("gram", "key").alias("h"), "key", "n")}
    leaders = prefixes.groupBy("gram").agg(*[F.min(x).alias(w) for w, x in ways.items()], F.count(F.lit(1)).alias("c")).where("c > 1")
    met = _with_leaders(prefixes.select("gram", F.col("key").alias("x"), F.col("n").alias("nx")), leaders, front)
    fair = lambda l: (F.col("nx") * den >= l["n"] * num) & (l["n"] * den >= F.col("nx") * num) & (l["key"] != F.col("x"))
    best = met.groupBy("x", "nx").agg(*[F.slice(F.array_sort(F.collect_set(F.when(fair(F.col(w)), F.col(w)))), 1, LEADERS).alias(w) for w in ways])
    pairs = best.select("x", "nx", F.explode(F.concat(*ways)).alias("l")).select("x", "nx", F.col("l.key").alias("y"), F.col("l.n").alias("ny"))
    return pairs.select(*_pair("x", "y", "nx", "ny")).distinct()


def _mixed(prefixes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Prefix rows of the n-grams that several clusters hold, with the text's cluster, the n-gram's largest, and the numbers of texts in all and outside it."""
    rows = prefixes.join(clusters, "key", "left").withColumn("label", F.coalesce("label", "key"))
    rows = store.written(rows, "prefix-clusters")
    sizes = rows.groupBy("gram", "label").count().groupBy("gram").agg(F.max(F.struct("count", "label")).alias("m"), F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("texts"))
    major = sizes.where("clusters > 1").select("gram", F.col("m.label").alias("major"), "texts", (F.col("texts") - F.col("m.count")).alias("outside"))
    return store.written(rows.join(store.written(major, "prefix-major"), "gram"), "prefix-mixed")


def _stars_again(mixed: DataFrame, front: int, turn: int, num: int, den: int) -> DataFrame:
    """More candidates: texts outside an n-gram's largest cluster, each with a few members of it, others in every turn."""
    leaders = mixed.where("label = major").groupBy("gram").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "gram", "key").alias("h"), "key", "n")).alias("l"), F.first("texts").alias("c"))
    met = _with_leaders(mixed.where("label != major").select("gram", F.col("key").alias("x"), F.col("n").alias("nx")), leaders, front)
    met = met.where((F.col("nx") * den >= F.col("l.n") * num) & (F.col("l.n") * den >= F.col("nx") * num))
    best = met.groupBy("x", "nx").agg(F.slice(F.array_sort(F.collect_set("l")), 1, 2 * LEADERS).alias("ls")).select("x", "nx", F.explode("ls").alias("l"))
    return best.select("x", "nx", F.col("l.key").alias("y"), F.col("l.n").alias("ny")).select(*_pair("x", "y", "nx", "ny")).distinct()


def _across(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs whose ends are in different clusters.

    Of a prefix n-gram's texts, those outside its largest cluster meet all the
    others; pairs inside a cluster never come up. The first n-gram that a pair
    has in common bounds its overlap by what comes behind it on either side.
    Both sides of a common n-gram are dealt into cells of about CELL_TEXTS by
    CELL_TEXTS texts, so no task meets all of them.
    """
    cells = lambda n: F.ceil(F.col(n) / CELL_TEXTS).cast("long")
    mine = lambda n: F.pmod(F.xxhash64(F.lit(6), "key"), cells(n))
    every_cell = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), cells(n) - 1))
    mixed = mixed.withColumns({"row": mine("outside"), "column": mine("texts")})
    few = mixed.where("label != major").select("gram", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("label").alias("lx"), "row", every_cell("texts").alias("column"))
    every = mixed.select("gram", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("label").alias("ly"), "major", every_cell("outside").alias("row"), "column")
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    met = few.join(every, ["gram", "row", "column"]).where(
        (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("major")) | (F.col("x") < F.col("y")))
        & (F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num)
        & (most * den >= (F.col("nx") + F.col("ny") - most) * num)
    )
    return met.select(*_pair("x", "y", "nx", "ny")).distinct()


def similar_groups(docs: DataFrame, width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard similarity of num / den or more of their word n-grams.

    component_id is the smallest doc_id that links reach. Null texts and texts
    without words have no n-grams and are linked with nothing. Repeated rows
    are documents with equal sets; a null doc_id counts in a group but never
    names it. Extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    scan = store.written(_scan(docs, width), "gram-scan")
    members = scan.where("hot IS NULL").select("doc_id", "key", "n")
    total = members.agg(F.sum("n")).first()[0] or 0
    part_bits = max(4, (-(-int(total) // PART_GRAMS) - 1).bit_length())
    hot = _hot(scan)
    parts = _shared(_deal(docs, hot, part_bits, width), part_bits)
    whole = parts.groupBy("key", "n").agg(F.flatten(F.collect_list("grams")).alias("grams"), F.flatten(F.collect_list("ranks")).alias("ranks"))
    whole = store.written(whole.where(F.size("grams") * den >= F.col("n") * num), "gram-shared")
    prefixes = store.written(_prefixes(whole, num, den), "gram-prefixes")
    front = prefixes.count()
    segments = store.written(_segments(whole, len(hot)), "gram-segments")

    stars = store.written(_stars(prefixes, front, num, den), "gram-stars")
    links = store.written(linked(stars, segments, num, den), "gram-links")
    for turn in range(TURNS):
        mixed = _mixed(prefixes, components(links).withColumnRenamed("node", "key"))
        left = mixed.groupBy("gram").agg(F.first(F.col("texts") * F.col("outside")).alias("m")).agg(F.sum("m")).first()[0] or 0
        if left <= max(FEW_MEETINGS, MEETINGS * front):  # few enough pairs across clusters to look at them all
            break
        more = store.written(_stars_again(mixed, front, turn, num, den), "gram-stars")
        found = store.written(linked(more, segments, num, den), "gram-links")
        links = store.written(links.union(found).distinct(), "gram-links")
        if found.count() * 10 < more.count():  # what is left is mostly unlike; more leaders won't join it
            mixed = _mixed(prefixes, components(links).withColumnRenamed("node", "key"))
            break
    else:
        mixed = _mixed(prefixes, components(links).withColumnRenamed("node", "key"))
    cross = store.written(_across(mixed, num, den), "gram-across")
    more = linked(cross, segments, num, den)
    labels = store.written(components(store.written(links.union(more), "gram-all-links")).withColumnRenamed("node", "key"), "gram-components")

    nodes = store.written(members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least")).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "gram-nodes")
    of_label = store.written(nodes.groupBy("label").agg(F.min("least").alias("component_id")), "gram-labels")  # written, so that a large group's side of the join can be split
    named = store.written(nodes.select("key", "label").join(of_label, "label").select("key", "component_id"), "gram-names")
    out = members.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT * FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
