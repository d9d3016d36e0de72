"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes. Where a token of each ends at one offset, a
group of tokens ends, and the two tokens that end there are linked. How often
two ids are linked in the whole corpus tells which tokens stand for each other.

Texts are cut before every single space between two other characters: no token
of either tokenizer crosses such a place, so a group ends there, and what lies
between is encoded and aligned once per distinct part and worker.

Links are written in chunks of texts, one row per chunk and stripe of STRIPE ids
of the second tokenizer: the distinct pairs, how often each comes, and the texts
it comes in. Counting adds the pairs of a stripe up in a dense matrix, chunk
after chunk, first for parts of the chunks and then for those parts, FAN_IN of
them at a time, until one row per stripe is left; maxima over the matrix's rows
say what is best. Scoring brings a stripe's counts and links together again, in
parts of the chunks, fills the dense matrix with the counts and reads every link
off it. So a task holds one matrix and a few sums per text, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm import store
from gaugeloom.llm.memory import slices, small_batches, tidy

STRIPE = 128
FAN_IN = 64  # rows of a stripe that are added up by one task
SCORE_CHUNKS, COUNT_SHARE = 32, 4 << 20  # chunks scored together: so many, or more, so that a chunk carries this many bytes of counts at most
GROUP_BYTES = 32 << 20  # of counts, that a task of scoring gets for its stripes
TEXTS, CHUNK_BYTES = 4_096, 6 << 20
BLOCK = 1 << 20  # characters of a long text that are cut at once
CACHE_PARTS, PART_LETTERS = 200_000, 48
TOGETHER = 1 << 18  # characters of texts whose parts are looked up and learnt at once
_CUT = re.compile(r"(?<=\S)(?= \S)")
# Fixed value: how byte-level tokenizers part a text before they merge bytes.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Aligned parts of texts under a byte-level `tokenizers` file (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, file_a: str, file_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        if self.a.get_vocab_size() > 1 << 16 or self.b.get_piece_size() > 1 << 16:
            raise ValueError("more than 65,536 ids")
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, token))
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.width_a, self.width_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ranks = self._ranks(file_a)
        self.parts: dict[str, tuple] = {}
        # Ids as text, with what may follow: ',' or '|' behind ids of A, ',' or ';' or a line end behind those of B.
        self.shown = [f"{i}{mark}" for mark, n in ((",", len(self.bytes_a)), ("|", len(self.bytes_a)), (",", len(self.bytes_b)), (";", len(self.bytes_b)), ("\n", len(self.bytes_b))) for i in range(n)]

    def _ranks(self, file_a: str):
        """The same tokenizer as one that ranks byte strings, several times as fast; None unless ids past the single bytes are in the order of the merges."""
        import tiktoken

        with open(file_a, encoding="utf-8") as f:
            file = json.load(f)
        vocab, level = file["model"]["vocab"], file["pre_tokenizer"]
        merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in file["model"]["merges"]]
        singles = sorted(i for t, i in vocab.items() if len(t) == 1)
        if file["normalizer"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or not level.get("use_regex", True) or singles != list(range(256)) or merged != list(range(256, 256 + len(merged))):
            return None
        return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks={self.bytes_a[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def _ids(self, text: str, short: bool) -> list[int]:
        """A's ids. Below U+0250 all know what a letter is; elsewhere, and for long parts, the tokenizer itself is asked."""
        if short and self.ranks is not None and (text.isascii() or max(text) < "\u0250"):
            return self.ranks.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _aligned(self, parts: list[str]) -> list[tuple] | None:
        """(groups as text, links as pairs of 16-bit ids, number of A's and of B's tokens) of each part; None if the bytes differ.

        The parts are encoded as one text, so several must be such as _CUT makes.
        """
        text = "".join(parts)
        raw = text.encode()
        a, b = self._ids(text, max(map(len, parts)) <= PART_LETTERS), self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a), np.array(b)
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        cuts, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        upto = np.searchsorted(cuts, np.cumsum([len(p.encode()) for p in parts])) + 1  # groups up to the end of each part
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        ids_a, ids_b, mark_a, mark_b = len(self.bytes_a), len(self.bytes_b), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a] = 1
        mark_b[last_b] = 1
        mark_b[last_b[upto - 1]] = 2
        shown = np.concatenate([a + mark_a * ids_a, b + mark_b * ids_b + 2 * ids_a])[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        groups = "".join(map(self.shown.__getitem__, shown.tolist())).encode().split(b"\n")
        links = np.stack([b[last_b], a[last_a]], 1).astype("<u2").tobytes()
        n_a, n_b = (np.diff(np.concatenate([[0], last[upto - 1] + 1])).tolist() for last in (last_a, last_b))
        begins = [0, *upto.tolist()]
        return [(groups[i], links[4 * begins[i] : 4 * begins[i + 1]], n_a[i], n_b[i]) for i in range(len(parts))]

    def _learn(self, needed: set[str]) -> dict[str, tuple]:
        """The alignment of parts that are not known yet; (None, ...) for those whose bytes differ. Short ones are kept."""
        lacking = [p for p in needed if p not in self.parts]
        alone = [p for p in lacking if len(p) < 2 or p[1].isspace() or p[-1].isspace() or "▁" in p]
        together: dict[bool, list[str]] = {True: [], False: []}
        for p in set(lacking).difference(alone):
            together[len(p) <= PART_LETTERS and (p.isascii() or max(p) < "\u0250")].append(p)
        new = {}
        for some in (x[i : i + 2_000] for x in together.values() for i in range(0, len(x), 2_000)):
            found = self._aligned(some)
            if found is None:
                alone += some
            else:
                new |= zip(some, found)
        for p in alone:
            found = self._aligned([p])
            new[p] = (None, b"", 0, 0) if found is None else found[0]
        kept = {p: x for p, x in new.items() if len(p) <= PART_LETTERS}
        if len(self.parts) + len(kept) > CACHE_PARTS:  # what was met first is frequent and stays, with what is needed now
            first = dict(list(self.parts.items())[: CACHE_PARTS // 2])
            self.parts = first | {p: self.parts[p] for p in needed if p in self.parts}
        self.parts |= kept
        return new

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """(number of A's tokens, of B's tokens, of groups, hash of the groups, links) of each text."""
        out: list[tuple] = []
        some: list[str] = []
        size = 0
        for text in texts:
            if len(text or "") > TOGETHER:  # by blocks
                out += self._small(some)
                some, size = [], 0
                out.append(self._one(_parts(text)))
                continue
            some.append(text or "")
            size += len(some[-1])
            if size > TOGETHER:
                out += self._small(some)
                some, size = [], 0
        return out + self._small(some)

    def _small(self, texts: list[str]) -> list[tuple]:
        cut = [list(_parts(t)) for t in texts]
        new = self._learn({p for blocks in cut for parts in blocks for p in parts})
        return [self._one(blocks, new) for blocks in cut]

    def _one(self, blocks, new: dict[str, tuple] | None = None) -> tuple:
        n_a, n_b, n_groups, links, digest = 0, 0, 0, [], hashlib.sha256()
        for parts in blocks:
            learnt = self._learn(set(parts)) if new is None else new
            found = list(map(self.parts.get, parts))
            if None in found:
                found = [f or learnt[p] for p, f in zip(parts, found)]
            groups = [f[0] for f in found]
            if None in groups:
                return (0, 0, 0, "", b"")
            joined = b";".join(groups)
            digest.update(b";" + joined if n_groups else joined)
            n_groups += joined.count(b"|")
            links.append(b"".join(map(itemgetter(1), found)))
            n_a += sum(map(itemgetter(2), found))
            n_b += sum(map(itemgetter(3), found))
        return (n_a, n_b, n_groups, digest.hexdigest(), b"".join(links)) if n_groups else (0, 0, 0, "", b"")


def _parts(text: str) -> Iterator[list[str]]:
    """The parts of space + text, in lists of about BLOCK characters."""
    if not text:
        return
    text, at = " " + text, 0
    while len(text) - at > 2 * BLOCK:
        found = _CUT.search(text, at + BLOCK)
        if found is None:
            break
        yield _CUT.split(text[at : found.start()])
        at = found.start()
    yield _CUT.split(text[at:])


@cache
def aligner(file_a: str, file_b: str) -> Aligner:
    return Aligner(file_a, file_b)


_ROWS = "doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, chunk long, place int, stripe int, pairs binary, times binary, texts binary"
_COUNTS = "stripe int, part long, pairs binary, counts binary"


def encoded(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Rows of two kinds: one per text, and (stripe not null) one per chunk of texts and stripe with its links.

    `pairs` are distinct ids of B and A, 16 bits each, in order; `times` how
    often each comes; `texts` the places in the chunk of the texts it comes in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunk = aligner(file_a, file_b), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, TEXTS, CHUNK_BYTES):
                got = model.texts(part.column(1).to_pylist())
                n, cols = len(got), list(zip(*got))
                numbers = [pa.array(c, pa.int64()) for c in cols[:3]]
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(cols[3]), pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32()), *none], names=names)
                links = np.frombuffer(b"".join(cols[4]), "<u2").reshape(-1, 2).astype(np.uint32)
                pair = (links[:, 0] << np.uint32(16)) | links[:, 1]
                text = np.repeat(np.arange(n, dtype="<u2"), [len(x) // 4 for x in cols[4]])
                order = np.argsort(pair, kind="stable")
                pair, text = pair[order], text[order]
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                distinct, times = pair[first], np.diff(np.concatenate([first, [len(pair)]]))
                stripe = (distinct >> np.uint32(16)) // STRIPE
                edge = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])) if len(distinct) else np.zeros(0, np.int64)
                rows = []
                for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(distinct)]):
                    until = int(first[y]) if y < len(first) else len(pair)
                    rows.append((int(stripe[x]), distinct[x:y].astype("<u4").tobytes(), times[x:y].astype("<u4").tobytes(), text[first[x] : until].tobytes()))
                if rows:
                    m, cols = len(rows), list(zip(*rows))
                    none = [pa.nulls(m, t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string())]
                    binaries = [pa.array(c, pa.binary()) for c in cols[1:]]
                    yield pa.RecordBatch.from_arrays([*none, pa.array([chunk] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(cols[0], pa.int32()), *binaries], names=names)
                chunk += 1

    schema = _ROWS.format(kind=docs.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "chunk", "place", "stripe", "pairs", "times", "texts"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), schema)


class Matrix:
    """Counts of one stripe: STRIPE ids of B by all ids of A."""

    def __init__(self, ids_a: int):
        self.ids_a = ids_a
        self.cells = np.zeros(STRIPE * ids_a, np.int64)

    def at(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs >> np.uint32(16)) % STRIPE).astype(np.int64) * self.ids_a + (pairs & np.uint32(0xFFFF))

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.cells, self.at(pairs), counts)

    def best(self) -> np.ndarray:
        """The highest count of each of B's ids."""
        return self.cells.reshape(STRIPE, self.ids_a).max(1)

    def taken(self, stripe: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs with a count, and their counts; the matrix is empty again."""
        at = np.flatnonzero(self.cells)
        pairs = ((at // self.ids_a + stripe * STRIPE) << 16 | at % self.ids_a).astype("<u4")
        counts = self.cells[at].astype("<i8")
        self.cells[at] = 0
        return pairs, counts


def _added(rows: DataFrame, ids_a: int) -> DataFrame:
    """Rows (stripe, part, pairs, counts) with those of one stripe and part added up. Counts are 32 bits wide as written, 64 as added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = Matrix(ids_a), None

        def row():
            pairs, counts = matrix.taken(now[0])
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([pairs.tobytes()]), pa.array([counts.tobytes()])], names=["stripe", "part", "pairs", "counts"])

        for batch in batches:
            for stripe, part, pairs, counts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if now != (stripe, part):
                    if now is not None:
                        yield row()
                    now = (stripe, part)
                pairs = np.frombuffer(pairs, "<u4")
                matrix.add(pairs, np.frombuffer(counts, "<u4" if len(counts) == 4 * len(pairs) else "<i8"))
        if now is not None:
            yield row()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(tidy(run), _COUNTS)


def pair_counts(links: DataFrame, ids_a: int, chunks: int) -> DataFrame:
    """(stripe, part = 0, pairs, counts): how often every pair of ids is linked, one row per stripe.

    Rows are added up FAN_IN at a time, so no task gets more of a stripe than
    that, however many chunks there are.
    """
    parts = max(1, -(-chunks // FAN_IN))
    rows = links.select("stripe", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"), "pairs", F.col("times").alias("counts"))
    counted = store.written(_added(rows, ids_a), "align-counts")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        counted = store.written(_added(counted.withColumn("part", F.col("part") % parts), ids_a), "align-counts")
    return counted


def _scored(links: DataFrame, counts: DataFrame, ids_a: int, groups: int, parts: int) -> DataFrame:
    """(chunk, place, n_links, n_best, count_sum) of each text that has links, once per group of stripes."""
    group, part = F.pmod("stripe", F.lit(groups)).alias("group"), F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    every = counts.select(group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "stripe", F.lit(-1).cast("long").alias("chunk"), "pairs", "counts", *none("times", "texts"))
    mine = links.select(group, part, "stripe", "chunk", "pairs", *none("counts"), "times", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now, stripe, best = Matrix(ids_a), None, None, None
        sums: dict[int, np.ndarray] = {}

        def rows():
            for chunk, table in sums.items():
                at = np.flatnonzero(table[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), *[pa.array(x[at]) for x in table]], names=["chunk", "place", "n_links", "n_best", "count_sum"])
            sums.clear()

        for batch in batches:
            for g, p, s, chunk, pairs, counts, times, texts in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if now != (g, p):
                    yield from rows()
                    now, stripe = (g, p), None
                pairs = np.frombuffer(pairs, "<u4")
                if chunk < 0:  # a stripe's counts come before its links
                    matrix.cells[:] = 0
                    matrix.add(pairs, np.frombuffer(counts, "<i8"))
                    stripe, best = s, matrix.best()
                    continue
                assert s == stripe
                count = matrix.cells[matrix.at(pairs)]
                top = count == best[(pairs >> np.uint32(16)) % STRIPE]
                times, text = np.frombuffer(times, "<u4").astype(np.int64), np.frombuffer(texts, "<u2")
                table = sums.setdefault(chunk, np.zeros((3, TEXTS), np.int64))
                np.add.at(table[0], text, 1)
                np.add.at(table[1], text, np.repeat(top.astype(np.int64), times))
                np.add.at(table[2], text, np.repeat(count, times))
        yield from rows()

    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = every.unionByName(mine).repartition(n, "group", "part").sortWithinPartitions("group", "part", "stripe", "chunk")
    return laid.mapInArrow(tidy(run), "chunk long, place int, n_links long, n_best long, count_sum long")


def _links(docs: DataFrame, file_a: str, file_b: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(texts, links, counts, number of chunks, ids of A)."""
    from tokenizers import Tokenizer

    small_batches(docs.sparkSession)
    rows = store.written(encoded(docs, file_a, file_b), "align-links")
    links = rows.where("stripe IS NOT NULL").select("chunk", "stripe", "pairs", "times", "texts")
    chunks, ids_a = rows.select("chunk").distinct().count(), Tokenizer.from_file(file_a).get_vocab_size()
    return rows.where("stripe IS NULL").drop("stripe", "pairs", "times", "texts"), links, pair_counts(links, ids_a, chunks), chunks, ids_a


def align(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: how each text's tokens line up.

    A encodes a space and the text, B the text, to which it puts a space itself.
    Null and empty texts, and those whose tokens don't spell the text (as those
    with U+2581), have no tokens: zeros and an empty string. A link is best if no
    id of A is linked more often with its id of B; ties are best together.
    Repeated rows are texts of their own and count as such; doc_id may be null
    or repeated; other columns are ignored; an empty table gives no rows. Long
    texts are cut in blocks; one part without a single space in it is encoded as
    a whole.
    """
    texts, links, counts, chunks, ids_a = _links(docs, file_a, file_b)
    size = counts.agg(F.sum(F.octet_length("pairs") + F.octet_length("counts"))).first()[0] or 0
    parts = max(1, -(-chunks // max(SCORE_CHUNKS, size // COUNT_SHARE)))
    groups = max(8, -(-size // GROUP_BYTES))
    scored = store.written(_scored(links, counts, ids_a, groups, parts), "align-scores")
    sums = ["n_links", "n_best", "count_sum"]
    zero = [F.lit(0).cast("long").alias(n) for n in sums]
    whole = texts.select("chunk", "place", F.struct("doc_id", "n_a", "n_b", "n_groups", "groups_sha256").alias("text"), *zero)
    every = whole.unionByName(scored.withColumn("text", F.lit(None).cast(whole.schema["text"].dataType)))
    got = every.groupBy("chunk", "place").agg(F.first("text", ignorenulls=True).alias("text"), *[F.sum(n).alias(n) for n in sums])
    return got.select("text.doc_id", "text.n_a", "text.n_b", "text.n_groups", *sums, "text.groups_sha256")


def dictionary(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """id_b, id_a, count, best: every pair of ids that is linked, how often, and whether it is the most frequent of its id_b."""
    _, _, counts, _, ids_a = _links(docs, file_a, file_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(ids_a)
        for batch in batches:
            for stripe, pairs, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                pairs, counts = np.frombuffer(pairs, "<u4"), np.frombuffer(counts, "<i8")
                matrix.add(pairs, counts)
                best = matrix.best()
                matrix.taken(stripe)
                b = pairs >> np.uint32(16)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.astype(np.int32), (pairs & np.uint32(0xFFFF)).astype(np.int32), counts, counts == best[b % STRIPE])], names=["id_b", "id_a", "count", "best"])

    return counts.select("stripe", "pairs", "counts").mapInArrow(tidy(run), "id_b int, id_a int, count long, best boolean")
