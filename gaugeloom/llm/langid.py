"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in the tasks and adds them up by a
shuffle; the matrix of log-probabilities, languages x BUCKETS, is all that
reaches the driver and the broadcast, with the languages' shares of the rows as
priors. Scoring hashes the n-grams of a block of documents in numpy, counts the
buckets that each document has, and adds up the matrix's rows of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.memory import slices, small_batches, tidy

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
ROWS, BLOCK_POINTS, CELLS = 128, 1 << 16, 1 << 20  # documents and code points counted at once, numbers gathered at once
MAX_LANGUAGES = 500
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # (BUCKETS, languages), float32
    prior: np.ndarray  # logarithms


def grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, buckets) of the n-grams that begin at each code point."""
    for order in ORDERS:
        h = np.full(max(0, len(points) - order + 1), order, np.uint32)
        for k in range(order):
            h = (h ^ points[k : k + len(h)]) * _MIX
            h ^= h >> np.uint32(15)
        yield order, (h * _MIX >> np.uint32(18)).astype(np.int32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def train_rows(docs: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """lang and whole text of at most `limit` labelled rows, those with the smallest hashes of doc_id."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    few = store.some(labelled.where("doc_id IS NOT NULL"), "doc_id", limit, seed=8).distinct().withColumnRenamed("doc_id", "_id")
    return labelled.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("lang", F.col("text").cast("string"))


def blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of a text in blocks that overlap, so that every n-gram of the highest order, and no other, begins in one block alone."""
    points, more = code_points(text), max(ORDERS) - 1
    for i in range(0, len(points), BLOCK_POINTS):
        yield points[i : i + BLOCK_POINTS + more]


def bucket_counts(text: str) -> np.ndarray:
    """How many n-grams of a text each bucket has."""
    out = np.zeros(BUCKETS, np.int64)
    for points in blocks(text):
        for _, g in grams(points):
            out += np.bincount(g[:BLOCK_POINTS], minlength=BUCKETS)
    return out


def train(docs: DataFrame, limit: int = TRAIN_ROWS, smoothing: float = 0.5) -> Model:
    """The model of `docs` (doc_id, lang, text). Bound: `limit` rows, those with the smallest hashes of doc_id.

    Rows with a null doc_id, lang or text teach nothing; repeated rows count as
    often as they occur; an empty table gives a model without languages. More
    than MAX_LANGUAGES languages are an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                have = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                have[:BUCKETS] += bucket_counts(text)
                have[BUCKETS] += 1  # the number of rows, for the prior
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    counts = train_rows(docs, limit).mapInArrow(tidy(count), "lang string, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((BUCKETS + 1, len(rows)), smoothing)
    for k, r in enumerate(rows):
        at, n = np.array(r["x"]).T
        table[at, k] += n
    words, prior = table[:BUCKETS], table[BUCKETS]
    return Model(tuple(r["lang"] for r in rows), np.log(words / words.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """((texts, languages): log P(n-grams of the text, language); the number of n-grams). At most ROWS texts."""
    out, total = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    counts = np.zeros((len(texts), BUCKETS), np.int32)
    for k, text in enumerate(texts):
        for points in blocks(text):
            for _, g in grams(points):
                g = g[:BLOCK_POINTS]
                total[k] += len(g)
                np.add(counts[k], np.bincount(g, minlength=BUCKETS), out=counts[k], casting="unsafe")
    text, bucket = np.nonzero(counts)
    step = max(1, CELLS // max(1, len(model.languages)))
    for i in range(0, len(text), step):
        t = text[i : i + step]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[first]] += np.add.reduceat(counts[t, bucket[i : i + step], None] * model.log_prob[bucket[i : i + step]].astype(np.float64), first, axis=0)
    return out, total


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, sharpness: float = 20.0) -> DataFrame:
    """The columns `keep` (default: all) of docs with lang_pred and score.

    The language is the likeliest one; ties go to the first in alphabetical
    order. The score is its posterior, from 0 to 1, for texts of up to
    `sharpness` n-grams; for longer ones the evidence is scaled to as many.
    Null texts, texts without a letter and any text under a model without
    languages get `und` and 0. Repeated rows score alike; an empty table stays
    empty. Columns of docs named lang_pred and score are replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in (part for b in batches for part in slices(b, b.num_columns - 1, ROWS)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            known = [k for k, t in enumerate(texts) if t and m.languages and LETTER.search(t)]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                s, total = scores([texts[k] for k in known], m)
                s *= np.minimum(1, sharpness / total)[:, None]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for k, best, row in zip(known, s.argmax(axis=1), p):
                    pred[k], score[k] = m.languages[best], float(row[best])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, F.col("text").cast("string").alias("_text")).mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")
