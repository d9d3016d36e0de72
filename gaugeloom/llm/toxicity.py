"""Toxicity with noisy-channel deobfuscation.

Words spelt with digits and signs, stretched by repeated letters or spaced out
are seen as the output of a noisy channel. A lattice lists what letters each
character may stand for (or that it stands for none), and that a separator ends
a word or stands inside one; a character trigram model learned from all texts
picks the likeliest path (Viterbi), and the restored words are scored along
with the plain ones.

A document's score is the logistic of a bias and the weights of the features
that it holds: words, and beginnings of words of four and five letters, whose
log-likelihood ratio on labelled rows is significant.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.memory import slices, small_batches, tidy
from gaugeloom.llm.words import mix, word_hashes

TRAIN_ROWS = 20_000
ROWS = 512
CACHE_ENTRIES, CACHE_LETTERS = 100_000, 64  # tokens kept, and the longest of them
STRETCH = 4_096  # characters after which the part of the path that is certain is settled
LETTER_BYTES = 256 << 10
PREFIXES = (4, 5)
BEGINNING = 3.0
# What a character may stand for, beside itself if it is a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou",
}
WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:[\w@$!|+][ .\-_*]){3,}[\w@$!|+](?!\w)")
LETTER, SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+(€£#*]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SEPARATED = re.compile(r"[^\W\d_](?:[.\-_*~][^\W_]){2,}")
EDGE = "!$*.,;:?\"'()[]{}<>|…"
LETTERS = 28  # word edge, a to z, any other letter
SWAP, LOSE, DROP, MERGE = math.log(0.3), math.log(0.002), math.log(0.02), math.log(0.6)
GAPS = " .-_*"
END_WORD, JOIN = math.log(0.05), math.log(0.95)  # of a separator in a run of single characters


def _index(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


@dataclass
class Model:
    """weights by feature kind (0: word, else length of the beginning), bias, and log P(letter | two before)."""

    weights: dict[int, dict[str, float]]
    bias: float
    letters: np.ndarray


def restore(noisy: str, letters: list[list[list[float]]], spaced: bool = False) -> str:
    """The likeliest reading of `noisy` (lower case).

    A state is the last two letters, of which the edge of a word is one; of all
    paths into a state the best stays, as a pointer back. A letter stands for
    itself, or for nothing if it repeats the one before; a sign stands for its
    letters or for nothing. If `spaced`, separators end a word or stand for nothing.
    Every STRETCH characters the beginning that all paths share is settled, which
    changes no path, so pointers are kept only behind it.
    """
    stretched = set(STRETCHED.findall(noisy)) | set(noisy[:1])
    read: list[str] = []
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []

    def settle(to: tuple[int, int]) -> None:
        out = []
        for step in reversed(back):
            to, x = step[to]
            out.append(x)
        read.append("".join(reversed(out)))
        back.clear()

    before = ""
    for c in noisy:
        if spaced and c in GAPS:
            options = [(" ", END_WORD), ("", JOIN)]
        elif c.isalpha():
            options = [(c, 0.0)]
            if c == before:
                options = [(c, DROP), ("", MERGE)] if c in stretched else [(c, 0.0), ("", DROP)]
        else:
            options = [(x, SWAP) for x in LEET.get(c, "")] + [("", LOSE if c in LEET else 0.0)]
        after: dict[tuple[int, int], float] = {}
        step: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), score in states.items():
            for x, cost in options:
                if x == " ":
                    to, s = (0, 0), score + cost + (letters[a][b][0] if b else 0.0)
                elif x:
                    i = _index(x)
                    to, s = (b, i), score + cost + letters[a][b][i]
                else:
                    to, s = (a, b), score + cost
                if to not in after or s > after[to]:
                    after[to], step[to] = s, ((a, b), x)
        back.append(step)
        states, before = after, before if spaced and c in GAPS else c
        if len(back) % STRETCH == 0:  # what all paths have in common is settled: the path stays the likeliest one, and memory is that of the rest
            at, merged = set(states), len(back)
            while len(at) > 1 and merged:
                merged -= 1
                at = {back[merged][to][0] for to in at}
            if merged:
                rest = back[merged:]
                del back[merged:]
                settle(at.pop())
                back.extend(rest)
    settle(max(states, key=lambda at: states[at] + letters[at[0]][at[1]][0]))
    return "".join(read)


def noisy_part(token: str) -> str | None:
    """What of a token is to be restored, if anything."""
    core = token.strip(EDGE)
    inner = token.rstrip(".,;:?\"')]}>…").lstrip("\"'([{<") if token[:1] in "$@|!" else core
    for part in (inner, core):
        if part and (LETTER.search(part) and SIGN.search(part) or STRETCHED.search(part) or SEPARATED.search(part)):
            return part
    return None


def _features(word: str, weights: dict[int, dict[str, float]]) -> list[tuple[int, str]]:
    found = [(0, word)] if word in weights[0] else []
    return found + [(n, word[:n]) for n in PREFIXES if len(word) > n - 1 and word[:n] in weights[n]]


class Scorer:
    """Scores texts; keeps what the tokens seen most recently amount to."""

    def __init__(self, model: Model):
        self.model, self.letters, self.new, self.old = model, model.letters.tolist(), {}, {}

    def token(self, token: str) -> tuple[tuple[int, str], ...]:
        have = self.old.get(token)
        if have is None:
            m = self.model
            found = [f for w in WORD.findall(token) for f in _features(w, m.weights)]
            if (part := noisy_part(token)) is not None:
                found += [f for w in WORD.findall(restore(part, self.letters)) for f in _features(w, m.weights)]
            have = tuple(found)
        if len(token) <= CACHE_LETTERS:
            if len(self.new) >= CACHE_ENTRIES:
                self.old, self.new = self.new, {}
            self.new[token] = have
        return have

    def score(self, text: str | None) -> float:
        m, lower = self.model, (text or "").lower()
        found: set[tuple[int, str]] = set()
        for token in set(lower.split()):
            have = self.new.get(token)
            if have is None:
                have = self.token(token)
            if have:
                found.update(have)
        for run in SPACED.findall(lower):
            for word in WORD.findall(restore(run, self.letters, spaced=True)):
                found.update(_features(word, m.weights))
        total = m.bias + sum(m.weights[k][f] for k, f in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, total))))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """toxic, text of at most `limit` labelled documents, those with the smallest hashes of doc_id."""
    few = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    few = few.join(F.broadcast(store.some(few, "doc_id", limit, seed=4)), "doc_id")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row per label and key of a text: what copies share must not count as often as there are copies.

    The key of near copies is most often the same, two independent minima over
    hashes of three words; a text of fewer words has its word sequence as key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1, ROWS)):
            least = []
            for h in word_hashes(batch.column(1).to_pylist()):
                g = h[:-2] + np.uint64(3) * h[1:-1] + np.uint64(5) * h[2:] if len(h) > 2 else h
                least.append((mix(g).min() >> np.uint64(1), mix(g ^ np.uint64(0x5851F42D4C957F2D)).min() >> np.uint64(1)) if len(h) > 2 else (len(h), int(h @ (2 * np.arange(len(h), dtype=np.uint64) + 1)) >> 1))
            keys = np.array(least, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["toxic", "text", "k1", "k2"])

    return sample.mapInArrow(tidy(run), "toxic int, text string, k1 long, k2 long").groupBy("k1", "k2", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


@cache
def _classes() -> np.ndarray:
    """_index of every code point that is a letter, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(len(out)):
        if WORD.match(chr(c)):
            out[c] = _index(chr(c))
    return out


def letter_counts(texts: list[str]) -> np.ndarray:
    """(LETTERS ** 3): how often a letter or the edge of a word follows two others, in lower case."""
    at = _classes()[np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    one, two = at[:-1], np.concatenate([[0], at[:-2]])
    use = (at[1:] > 0) | (one > 0)
    return np.bincount(((np.where(one > 0, two, 0) * LETTERS + one) * LETTERS + at[1:])[use], minlength=LETTERS**3)


def letter_model(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts. A task returns at most LETTERS ** 3 rows, as does their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(LETTERS**3, np.int64)
        for batch in (part for b in batches for part in slices(b, 0, ROWS, LETTER_BYTES)):
            sums += letter_counts([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["gram", "n"])

    counts = np.full(LETTERS**3, 0.05)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] += r["n"]
    return counts.reshape((LETTERS,) * 3)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """The model of labelled documents (weights) and of all texts (letters). Bound of the weights: `limit` rows.

    Labels that are null, or of a null doc_id or one that docs lacks, teach
    nothing; of several labels of a doc_id the most toxic counts. Null texts are
    empty. Without toxic or without clean rows all texts score alike, below 0.5.
    """
    small_batches(docs.sparkSession)
    sample = one_of_copies(labelled(docs, labels, limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        rows = [0, 0]
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = set(WORD.findall(text.lower()))
                rows[y] += 1
                (toxic if y else clean).update({(0, w) for w in words} | {(n, w[:n]) for n in PREFIXES for w in words if len(w) >= n})
        out = [(k, f, toxic[k, f], clean[k, f]) for k, f in toxic.keys() | clean.keys()]
        out.append((-2, "", rows[1], rows[0]))
        cols = list(zip(*out))
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "feature", "toxic", "clean"])

    counts = sample.mapInArrow(tidy(count), "kind int, feature string, toxic long, clean long").groupBy("kind", "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = store.written(counts, "toxicity-counts")  # of at most `limit` documents
    n = counts.where("kind = -2").first()
    features = counts.where("kind >= 0").count()
    letters = letter_model(docs)
    weights: dict[int, dict[str, float]] = {k: {} for k in (0, *PREFIXES)}
    if n is None or not n["toxic"] or not n["clean"]:
        return Model(weights, -2.0, np.log(letters / letters.sum(axis=2, keepdims=True)))
    nt, nc = float(n["toxic"]), float(n["clean"])
    term = lambda x, of, share: F.when(x > 0, x * F.log(x / (of * share))).otherwise(0.0)
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    g2 = 2 * (term(t, t + c, nt / (nt + nc)) + term(c, t + c, nc / (nt + nc)))
    ratio = F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
    sure = ratio - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))  # less a standard error: what is rare has no say of its own
    picked = counts.where("kind >= 0").select("kind", "feature", "toxic", "clean", g2.alias("g2"), sure.alias("sure"), ratio.alias("ratio")).where((F.col("g2") > 2 * math.log(max(features, 2))) & (F.col("ratio") > 2) & (F.col("sure") > 0) & (t >= 4 * c))
    for r in picked.orderBy(F.desc("g2"), "kind", "feature").collect():  # significant features of at most `limit` documents
        most = BEGINNING if r["kind"] == PREFIXES[0] else math.inf  # the shortest beginnings are shared by innocent words
        weights[r["kind"]][r["feature"]] = min(r["sure"], r["g2"] / 8, most)
    for w, _ in weights[0].items():  # the channel model expects what obfuscation hides
        at = [0, 0, *map(_index, w), 0]
        for gram in zip(at, at[1:], at[2:]):
            letters[gram] += letters[gram[0], gram[1]].sum() * 0.1
    return Model(weights, math.log(nt / nc) - 1, np.log(letters / letters.sum(axis=2, keepdims=True)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of docs with toxicity, from 0 to 1.

    Null and empty texts score as the bias alone. Rows are independent:
    repeated rows score alike, an empty table stays empty. Time grows with a
    text's length, with or without blanks. A column of docs named toxicity is replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in (part for b in batches for part in slices(b, b.num_columns - 1, ROWS)):
            got = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*kept, "toxicity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, F.col("text").cast("string").alias("_text")).mapInArrow(tidy(run), f"{kinds}, toxicity double")
