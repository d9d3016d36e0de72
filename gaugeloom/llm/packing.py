"""Packing along a space-filling curve.

A document's hashed words are projected to a few dimensions, and its place is
that point's position on a Hilbert curve, so documents with much in common
follow each other. Documents are range-partitioned and sorted by position, and
those of a range are laid end to end into sequences, cut where one is full.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.memory import slices, small_batches, tidy
from gaugeloom.llm.words import word_hashes

DIMS, BITS = 4, 8
END = 1
ROWS, SLICE_BYTES = 5_000, 4 << 20
PIECES = 1_024
RANGE_SEQUENCES = 64  # a range has so many full sequences at least,
RANGE_TOKENS = 1 << 25  # and so many tokens at most
CACHE_WORDS, WORD_BYTES = 300_000, 64  # words kept, of so many bytes at most
STOPS = r"([a-z\x{df}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([.,]) "  # a stop behind a Latin letter is a token of its own

_SIGNS = np.array([[1 if pattern >> d & 1 else -1 for d in range(DIMS)] for pattern in range(1 << DIMS)])


def project(hashes: list[np.ndarray]) -> np.ndarray:
    """(documents, DIMS) cells: each dimension adds up a random sign per word; the mean is squashed to BITS bits."""
    n = np.array([len(h) for h in hashes], np.int64)
    if not n.sum():
        return np.full((len(hashes), DIMS), 1 << (BITS - 1), np.uint32)
    pattern = (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) & ((1 << DIMS) - 1)
    seen = np.bincount(np.repeat(np.arange(len(hashes)) << DIMS, n) | pattern, minlength=len(hashes) << DIMS).reshape(len(hashes), -1)
    mean = seen @ _SIGNS / np.maximum(n, 1)[:, None]
    return ((np.tanh(3 * mean) + 1) * ((1 << BITS) - 1) / 2).astype(np.uint32)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Positions on the Hilbert curve through the cells, by Skilling's transform of the coordinates (2004)."""
    x = cells.T.copy()
    n = len(x)
    q = np.uint32(1 << (BITS - 1))
    while q > 1:  # undo the rotations from the coarsest level on
        low = np.uint32(q - 1)
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint32(1 << (BITS - 1))
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return out


def curve_keys(texts: list[str | None]) -> np.ndarray:
    """Curve positions. Equal texts share one, so ranges also go by the id."""
    return hilbert(project(word_hashes(texts)))


class Tokens:
    """Ids, 16 bits each, of texts under a `tokenizers` file whose pre-tokenizer splits at blanks and lower-cases.

    Blank-separated words are encoded once and kept with their ids in Arrow
    arrays; of more than CACHE_WORDS the half that was met longest ago goes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("more than 65,536 ids")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.met, self.calls = np.zeros(0, np.int64), 0

    @staticmethod
    def _plain(word: str) -> bool:
        """One token run: letters only, of scripts whose lower case and composition are letters again."""
        return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of the words."""
        out = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if self._plain(w)]
        for i in range(0, len(plain), 2_000):  # all in one text: every word ends with the only token of its that ends words
            part = plain[i : i + 2_000]
            ids = np.array(self.model.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, np.uint16)
            ends = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            for k, a, b in zip(part, [0, *ends], ends, strict=False):
                out[k] = data[a:b]
        rest = [i for i, w in enumerate(words) if w and not self._plain(w)]
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            for k, e in zip(part, self.model.encode_batch_fast([words[k] for k in part], add_special_tokens=False)):
                out[k] = array("H", e.ids).tobytes()
        return out

    def encode(self, texts: pa.Array) -> pa.BinaryArray:
        """Each text's ids, 16 bits each. Words are looked up once per call; the ids of the distinct ones are dealt out by Arrow."""
        flat = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not pc.any(pc.match_substring(flat, "<|")).as_py():  # special tokens are told apart by case, before anything else
            flat = pc.replace_substring_regex(pc.ascii_lower(flat), STOPS, r"\1 \2 ")
        rows = pc.split_pattern(flat, " ")
        coded = rows.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        lacking = coded.dictionary.filter(pc.is_null(at))
        learnt = pa.array(self._learn(lacking.to_pylist()), pa.binary())
        known = at.to_numpy(zero_copy_only=False)
        fresh, self.calls = np.isnan(known) if known.dtype.kind == "f" else np.zeros(len(known), bool), self.calls + 1
        place = np.where(fresh, len(self.words) + np.cumsum(fresh) - 1, known).astype(np.int32)
        self.met[place[~fresh]] = self.calls
        ids = pa.concat_arrays([self.ids, learnt])
        dealt = ids.take(pa.array(place).take(coded.indices))
        self._keep(lacking, learnt)
        of_word = np.frombuffer(dealt.buffers()[1], np.int32)[dealt.offset :]
        of_text = of_word[rows.offsets.to_numpy() - rows.offsets[0].as_py()] if len(texts) else np.zeros(1, np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(of_text.astype(np.int32)), dealt.buffers()[2]])

    def _keep(self, words: pa.StringArray, ids: pa.BinaryArray) -> None:
        short = pc.less_equal(pc.binary_length(words), WORD_BYTES)
        self.words, self.ids = pa.concat_arrays([self.words, words.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
        self.met = np.concatenate([self.met, np.full(len(self.words) - len(self.met), self.calls)])
        if len(self.words) > CACHE_WORDS:
            late = np.sort(np.argsort(self.met, kind="stable")[-CACHE_WORDS // 2 :])
            self.words, self.ids, self.met = self.words.take(pa.array(late)), self.ids.take(pa.array(late)), self.met[late]


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def lengths(tokens_: int, longest: int) -> list[int]:
    """Sequence lengths for so many tokens: full ones, then powers of two, which need no padding."""
    return [longest] * (tokens_ // longest) + [1 << b for b in range(longest.bit_length(), -1, -1) if (tokens_ % longest) >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, ranges: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids, then END, are laid along the curve; a piece is what of
    a document falls into one sequence. Null texts are empty: they have END
    alone. Repeated rows are documents of their own; extra columns are ignored;
    an empty table gives no pieces. doc_id is taken as a long; rows without one
    are packed under null. Texts are encoded in slices of bounded bytes; a very
    long one is a slice of its own and spreads over as many sequences as it fills.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, ROWS, SLICE_BYTES):
                keys = curve_keys(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), model.encode(part.column(1))], names=["doc_id", "key", "ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # pieces of the sequence that is not full
        used, sequence = 0, 0
        out: list[tuple] = []

        def rows():
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(body, np.uint16), np.uint16(END)).astype("<u4")
                at = 0
                while at < len(ids):
                    n = min(longest - used, len(ids) - at)
                    held.append((doc, at, ids[at : at + n], len(ids)))
                    at, used = at + n, used + n
                    if used == longest:
                        offset = 0
                        for d, s, part, total in held:
                            out.append((d, s, len(part), part.tobytes(), total, first + sequence, offset))
                            offset += len(part)
                        held, used, sequence = [], 0, sequence + 1
                if len(out) >= PIECES:
                    yield rows()
                    out.clear()
        for n in lengths(used, longest):  # what is left over
            offset = 0
            while offset < n:
                d, s, part, total = held.pop(0)
                k = min(n - offset, len(part))
                out.append((d, s, k, part[:k].tobytes(), total, first + sequence, offset))
                offset += k
                if k < len(part):
                    held.insert(0, (d, s + k, part[k:], total))
            sequence += 1
        yield rows()

    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(encode), "doc_id long, key long, ids binary")
    encoded = store.written(encoded, "packing-tokens", "lz4_raw")
    if ranges is None:  # as many as shuffles have, but not of fewer than RANGE_SEQUENCES full sequences, nor of more than RANGE_TOKENS
        total = (encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 2
        ranges = max(1, -(-total // RANGE_TOKENS), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (RANGE_SEQUENCES * longest)))
    ordered = encoded.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(tidy(lay), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
