"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash, and every source is a flow that is served in
proportion to its target. A document's virtual finish time is the number of its
source's words up to its end divided by that target. All documents are
range-sorted by it, and the budget is spent at virtual time 1: what is being
served then is cut there, so every source gets its target to the word, and the
mix is in these proportions from its start on, wherever it is stopped.

A source whose target is above its size is served again from its first document
on, as often as `most` allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.running import running

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words, as a fraction
MOST = 2
SEED = "13"
WORD = r"[^\x20\x09-\x0D]+"
_OWN = ["row", "source", "size", "source_size", "target", "pass", "words", "position"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> these and rank, target double, quota long: the whole words of the target.

    Sources, by code point and null last, weigh `weights` in turn and share
    `share` of all words. Targets stop at `most` times a source's size, and the
    excess is reshared by weight until none is above. A source is a row; each
    round of resharing is one aggregate over them and brings two numbers back.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-sources")
    ranked = store.written(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-ranks")
    num, den = share
    total = ranked.agg(F.sum(exact("source_size"))).first()[0] or 0
    above, count = F.lit(False), -1
    while True:  # more sources stop in every round but the last
        left = ranked.agg(
            F.sum(F.when(above, exact("source_size"))).alias("stopped"), F.sum(F.when(~above, exact("weight"))).alias("weights"), F.count_if(above).alias("count"),
        ).first()
        if left["count"] == count:
            break
        count = left["count"]
        words, by = int(num * total - den * most * (left["stopped"] or 0)), int(den * (left["weights"] or 0))
        above = exact("source_size") * most * F.lit(by).cast("decimal(38,0)") < exact("weight") * F.lit(words).cast("decimal(38,0)") if by else F.lit(True)
        if not by:
            break
    whole = F.col("source_size") * most
    share_of = F.col("weight").cast("long") * F.lit(words).cast("long")
    target = F.when(above, whole.cast("double")).otherwise(share_of.cast("double") / F.lit(max(by, 1)).cast("double"))
    quota = F.when(above, whole).otherwise((share_of - share_of % F.lit(max(by, 1)).cast("long")) / F.lit(max(by, 1))).cast("long")
    return store.written(ranked.select("source", "source_size", "rank", target.alias("target"), quota.alias("quota")), "mix-targets")


def fair_queue(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix, a row per document and pass that it is served in: row, `keep`, source, size, source_size, target, pass, words, position.

    `words` is how many words of the document the mix takes in that pass, from
    its first on, and `position` how many words of the mix come before. A
    document of which the mix takes nothing has one row with 0 words and a null
    position, so `row` numbers all documents. `keep` names the columns to carry,
    as the text.

    Null and empty texts have 0 words. A null source is a source of its own, the
    last one. Repeated rows are documents of their own; which of two equal rows
    comes first makes no difference. A null doc_id is hashed as an empty one. A
    text is only counted, however long it is. An empty table gives no rows.
    Other columns are ignored; `keep` may not name a column of the result.
    """
    if set(keep) & set(_OWN):
        raise ValueError(f"columns {sorted(set(keep) & set(_OWN))} clash with those of the result")
    place = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(*keep, F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), place.alias("_place"), F.col("doc_id").alias("_id"))
    sized = store.written(sized, "mix-sizes")
    of = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    known = sized.join(of.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # One order for all: by source, then shuffled. A source's words before a document are all words before it, less those of the sources before.
    numbered = running(known, [F.col("rank"), F.col("_place"), F.col("_id"), F.col("size"), F.xxhash64(*keep)], {"row": F.lit(1), "_upto": F.col("size")}, "mix-shuffled")
    starts = running(of.select("rank", "source_size"), [F.col("rank")], {"_start": F.col("source_size")}, "mix-starts").select("rank", "_start")
    numbered = store.written(numbered.join(starts, "rank").withColumn("_upto", F.col("_upto") - F.col("_start")).drop("_start", "_place", "_id"), "mix-numbered")

    served = numbered.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    before = F.col("pass") * F.col("source_size") + F.col("_upto")
    served = served.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota") - before))).withColumn("_finish", (before + F.col("words")).cast("double") / F.col("target"))
    queue = running(served.where("words > 0"), [F.col("_finish"), F.col("rank"), F.col("row"), F.col("pass")], {"position": F.col("words")}, "mix-queue")
    rest = served.where("words = 0 AND pass = 0").withColumn("position", F.lit(None).cast("long"))
    return queue.unionByName(rest).select("row", *keep, "source", "size", "source_size", "target", "pass", "words", "position")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, substr(md5('13:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, row_number() OVER p AS k, coalesce(sum(source_size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW p AS (ORDER BY source_size * 10 // weight, rank)),
f AS (SELECT min(k) AS k FROM o WHERE 2 * source_size * 2 * weights >= weight * (3 * total - 4 * stopped)),
v AS (SELECT (3 * total - 4 * stopped)::BIGINT AS words, (2 * weights)::BIGINT AS parts FROM o JOIN f USING (k)),
t AS (
  SELECT o.source, o.source_size, o.rank, CASE WHEN o.k < f.k THEN (2 * source_size)::DOUBLE ELSE (weight * words)::DOUBLE / parts::DOUBLE END AS target, CASE WHEN o.k < f.k THEN 2 * source_size ELSE weight * words // parts END AS quota
  FROM o, f, v),
n AS (
  SELECT d.r, d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY place, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto,
    row_number() OVER (ORDER BY t.rank, place, doc_id NULLS FIRST, size, r) AS row
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT n.*, pass, greatest(0, least(size, quota - pass * source_size - upto)) AS words FROM n, (VALUES (0), (1)) AS x(pass)),
p AS (SELECT *, sum(words) OVER (ORDER BY (pass * source_size + upto + words)::DOUBLE / target, rank, row, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS position FROM q WHERE words > 0)
SELECT n.doc_id, n.size::BIGINT AS size, n.source_size, n.target, coalesce(sum(p.words), 0)::BIGINT AS taken, min(CASE WHEN p.row IS NOT NULL THEN coalesce(p.position, 0) END)::BIGINT AS mix_position
FROM n LEFT JOIN p ON p.row = n.row GROUP BY n.row, n.doc_id, n.size, n.source_size, n.target
"""
