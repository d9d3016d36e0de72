"""Line dedup: the first document with a line keeps it, later ones lose it.

Lines travel as hashes. They are range-partitioned by hash and sorted inside
each partition by hash, document and position, so one pass over a partition
streams first occurrences. Very common lines would make one partition long:
they are found by a pre-aggregated count, their first documents are broadcast
(HOT_KEYS at most), and their lines never enter the ranges. What a document
loses comes back as a sparse bitmap of its lines, not as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeloom.llm import store

# Fixed values: [\x20\x09-\x0D] and the ASCII letters.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CODE_POINTS = 10
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """doc_id, text_hash, words: of each document that loses lines, array<struct<word, bits>>.

    `bits` are 64 lines from line 64 * word on, 1 for a line that stays; a word
    whose lines all stay is not listed. Documents are told apart by doc_id and
    text, so repeated rows get one bitmap. Lines of a null doc_id neither
    count as occurrences nor are dropped.
    """
    keyed = (
        docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_code_points)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    keyed = store.written(keyed, "line-keys")
    # A hot key has more than a HOT_KEYS-th of all lines, so there are fewer than HOT_KEYS of them.
    limit = max(HOT_ROWS, keyed.count() // HOT_KEYS)
    hot = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hot_doc")).where(F.col("n") > limit).drop("n")
    marked = keyed.join(F.broadcast(hot), ["h1", "h2"], "left")
    of_key = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    ordered = marked.where("hot_doc IS NULL").repartitionByRange("h1", "h2")
    cold = ordered.withColumn("first_doc", F.first("doc_id").over(of_key)).where("doc_id > first_doc")
    places = ["doc_id", "text_hash", "pos"]
    lost = cold.select(places).union(marked.where("doc_id > hot_doc").select(places))
    bits = lost.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("words"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs and n_lines, n_dropped, kept (the text of the lines that stay); columns of these names are replaced."""
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.map_from_entries("words").alias("_words"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    joined = base.join(b, (F.col("doc_id") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    lines = _lines(F.col("text"))
    stays = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.try_element_at("_words", (i / 64).cast("int")), i % 64), F.lit(1).cast("byte")) == 1)
    kept = F.when(F.col("_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    dropped = F.coalesce(F.aggregate(F.map_values("_words"), F.lit(0), lambda a, x: a + 64 - F.bit_count(x)), F.lit(0))
    own = {"n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long"), "kept": kept}
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in own], *[v.alias(k) for k, v in own.items()])


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """docs with n_lines, n_dropped and kept. Null and empty texts are one empty line; an empty table stays empty."""
    return with_bitmaps(docs, keep_bitmaps(docs, min_code_points))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, i, line, coalesce(l.doc_id > f.first_doc, false) AS lost FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
