"""The corpus queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeloom.llm import alignment, chat, jaccard, kmeans, langid, lines, media, mixing, packing, pieces, shards, topk, toxicity


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file `name` is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, root, name):
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_exact_topk(spark, root):
    return topk.top_k(_table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_line_dedup(spark, root):
    kept = lines.dedup_lines(_table(spark, root, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_audio_features(spark, root):
    got = media.audio_features(_table(spark, root, "documents"))
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", "n_frames", "n_segments", F.sha2("tensors", 256)).alias("feature"),
    )


def op4_curve_packing(spark, root):
    got = packing.pack(_table(spark, root, "documents"), tokenizer_path("word_bpe_49k.json"), longest=2048)
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_kd_sharding(spark, root):
    return shards.shard_documents(_table(spark, root, "documents"), shards=40)


def op6_ngram_jaccard(spark, root):
    return jaccard.similar_groups(_table(spark, root, "documents"), width=5, num=75, den=100)


def op7_toxicity(spark, root):
    docs = _table(spark, root, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = _table(spark, root, "labels")
    model = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    got = toxicity.score(docs, model, keep=["doc_id"])
    return got.select("doc_id", (remainder == 1).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_language_id(spark, root):
    docs = _table(spark, root, "documents").select("doc_id", "lang", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.train(docs.where(remainder != 0))
    return langid.identify(docs, model, keep=["doc_id"]).withColumn("held_out", remainder == 0)


def op9_sentencepiece(spark, root):
    got = pieces.encode_decode(_table(spark, root, "documents"), tokenizer_path("piece_bpe_32k.model"))
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_chat_format(spark, root):
    return chat.format_chats(_table(spark, root, "conversations"))


def op11_alignment(spark, root):
    return alignment.align(_table(spark, root, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_exponion(spark, root):
    return kmeans.clusters(_table(spark, root, "embeddings"))


def op13_fair_mix(spark, root):
    got = mixing.fair_queue(_table(spark, root, "documents"))
    alike = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return got.groupBy("row").agg(*alike, F.sum("words").alias("taken"), F.min("position").alias("mix_position")).drop("row")


QUERIES = {
    f.__name__: f
    for f in (op1_exact_topk, op2_line_dedup, op3_audio_features, op4_curve_packing, op5_kd_sharding, op6_ngram_jaccard, op7_toxicity, op8_language_id, op9_sentencepiece, op10_chat_format, op11_alignment, op12_exponion, op13_fair_mix)
}
ORACLE_SQL = {"op1_exact_topk": topk.ORACLE_SQL, "op6_ngram_jaccard": jaccard.ORACLE_SQL, "op2_line_dedup": lines.ORACLE_SQL, "op10_chat_format": chat.ORACLE_SQL, "op12_exponion": kmeans.ORACLE_SQL, "op13_fair_mix": mixing.ORACLE_SQL}
