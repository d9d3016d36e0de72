"""The corpus pipeline: five stages from `documents` to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept. run() writes each stage's documents to the shared folder and reads them
back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.llm import jaccard, langid, lines, packing, queries, store, toxicity

LANGUAGE_FROM = 0.6
TOXIC_FROM = 0.7
SEQUENCE = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, no letter in it, or a likeliest language below LANGUAGE_FROM.

    What languages look like is learnt from the documents at hand that have a
    label; if none has, only the letters decide. Null labels and ids, repeated
    rows and long texts are as good as any; an empty table stays empty.
    """
    model = langid.train(docs.select("doc_id", "lang", "text"))
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    return langid.identify(docs, model).where(F.col("score") >= LANGUAGE_FROM).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of TOXIC_FROM or more; what is toxic is learnt from the labels of those at hand.

    Null and empty texts score as the prior says; rows without an id are scored
    and teach nothing; repeated rows score alike; an empty table stays empty.
    """
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves a line that several documents hold to the first of them; n_chars follows the text.

    A document that lost lines and has nothing but blanks left, as a copy, goes.
    Null and empty texts stay; of repeated rows, which are one document, each
    keeps its lines; an empty table stays empty.
    """
    kept = lines.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(lines.BLANKS)) != ""))
    return kept.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near copies the document with the smallest doc_id. Rows without a doc_id stay: none is known to be a later one. Rows of one doc_id stay or go together; an empty table stays empty."""
    groups = jaccard.similar_groups(docs)
    later = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("later"))
    later = store.written(later.where("later").select("doc_id"), "later-ids")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left along the curve: a row per piece of a document. Null texts are empty, repeated rows documents of their own; an empty table gives no pieces."""
    got = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), longest=SEQUENCE)
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("toxicity", toxic), ("line_dedup", repeated_lines), ("near_copies", near_copies), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = store.made()
    for name, stage in STAGES[:-1]:
        docs, path = store.written_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        store.discard(spark, mark, keep=path)  # the stage's own tables, and the documents that it read
    return STAGES[-1][1](spark, docs, sf_dir)
