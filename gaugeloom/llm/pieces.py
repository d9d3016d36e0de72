"""SentencePiece (BPE model) encoding by a table of each prefix's last token, and decoding.

For every prefix of a string, exactly one vocabulary entry can be the last
token of its encoding. An Aho-Corasick automaton lists the entries that end at a
position; the right one is the one whose predecessor, the last token of the
prefix before it, is compatible: the two, side by side, survive the merges.
Compatibility is decided by undoing merges on both sides of the boundary. The
ids come out backwards, from the last prefix on.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.memory import slices, small_batches, tidy

SPACE = "▁"
ROWS_OUT = 256
CACHE_ENTRIES = 300_000
CACHE_LETTERS = 64  # longer chunks are not kept
NORMAL, BYTE = 1, 6  # piece types of the model format


class Encoder:
    """One BPE model with identity normalization and byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or trainer.model_type != 2 or not trainer.byte_fallback or len(proto.pieces) > 1 << 16:
            raise ValueError("only BPE models of at most 65,536 pieces, with identity normalization, a dummy prefix and byte fallback")
        normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        self.id_of = {p: i for p, _, i in normal}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        # Ranks: single characters first, then merged pieces from the highest score down. Runs of
        # spaces share the lowest score and touch nothing else; they are encoded by run().
        self.runs = {len(p) for p, _, _ in normal if set(p) == {SPACE}}
        words = [(p, s) for p, s, _ in normal if len(p) > 1 and set(p) != {SPACE}]
        if any(SPACE in p[1:] or "\n" in p for p, _ in words) or len({s for _, s in words}) != len(words) or 1 not in self.runs:
            raise ValueError("spaces must begin pieces, and pieces must have scores of their own and no line end")
        self.rank = {p: k - len(normal) for k, (p, _, _) in enumerate(x for x in normal if len(x[0]) == 1)}
        self.rank |= {p: k for k, (p, _) in enumerate(sorted(words, key=lambda x: -x[1]))}
        self.halves: dict[str, tuple[str, str]] = {}
        for p, _ in words:
            if (split := self._last_merge(p)) is not None:
                self.halves[p] = split
        self.automaton = ahocorasick.Automaton()
        for p in (*self.halves, *(p for p in self.rank if len(p) == 1)):
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}  # characters side by side in some piece
        self.shown = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
        for b, i in self.byte_id.items():
            self.shown[i] = bytes([b])

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge into `piece`; None if its characters merge into something else."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], 1 << 30), i))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1])

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is those two: no merge across the boundary comes before theirs."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= CACHE_ENTRIES:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: str, right: str) -> bool:
        rank, halves = self.rank, self.halves
        # The sides as they stood when the later of both was not merged yet, and so on back; a merge
        # across the boundary happens if it ranks before the merge that would use up either side.
        limit = 1 << 30
        while True:
            if rank.get(left + right, 1 << 30) < limit:
                return False
            a, b = rank.get(left, -1 << 30), rank.get(right, -1 << 30)
            if left not in halves and right not in halves:
                return True
            if right not in halves or (left in halves and a > b):
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]  # of equal merges the left one comes first

    def run(self, n: int) -> list[int]:
        """Ids of n spaces that no word takes. All their merges have one score, so the leftmost comes first."""
        most = max(self.runs)
        whole = max(0, n // most - 2)  # the leftmost parts grow to the longest piece before those behind them
        parts = [1] * (n - whole * most)
        while (i := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.runs), None)) is not None:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.id_of[SPACE * k] for k in [most] * whole + parts]

    def word(self, s: str) -> list[int]:
        """Ids of a string without line ends and with a space mark at most at its start."""
        last: list[str] = [""] * len(s)
        for end, token in self.automaton.iter(s):
            start = end - len(token)
            if start < 0 or not last[start] or self.compatible(last[start], token):
                last[end] = token if not last[end] or len(token) > len(last[end]) else last[end]
        out, at = [], len(s) - 1
        while at >= 0:
            if last[at]:
                out.append(self.id_of[last[at]])
                at -= len(last[at])
            else:  # a character that the vocabulary lacks never merges
                out += [self.byte_id[b] for b in reversed(s[at].encode())]
                at -= 1
        return out[::-1]

    def chunk(self, s: str) -> list[int]:
        """Ids of space marks followed by characters other than space marks and line ends."""
        spaces = len(s) - len(s.lstrip(SPACE))
        if not spaces:
            return self.word(s)
        if spaces == len(s):
            return self.run(spaces)
        tail = self.word(s[spaces - 1 :])
        if tail[0] == self.id_of[SPACE]:  # the word does not take its space
            return self.run(spaces) + tail[1:]
        return self.run(spaces - 1) + tail

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space of the dummy prefix; byte pieces make up characters again."""
        return b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")[1:]


@cache
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


class Chunks:
    """Ids of chunks, 16 bits each. Two generations bound the memory: what a full one held and is asked for again stays."""

    def __init__(self, model: Encoder):
        self.model, self.new, self.old = model, {}, {}

    def get(self, s: str) -> bytes:
        have = self.new.get(s)
        if have is None:
            have = self.old.get(s)
            if have is None:
                if len(s) > CACHE_LETTERS or (len(s) > 2 and s[-2:] not in self.model.inside):
                    have = b"".join(map(self._part, self._cut(s)))
                else:
                    have = array("H", self.model.chunk(s)).tobytes()
            self._keep(s, have)
        return have

    def _cut(self, s: str) -> list[str]:
        """Parts of a chunk that no token crosses, as before most punctuation: no piece has those two characters side by side.

        Short chunks are cut at their end only, which keeps their words whole for the cache.
        """
        inside, at, out = self.model.inside, 0, []
        if len(s) <= CACHE_LETTERS:
            end = len(s)
            while end > 2 and s[end - 2 : end] not in inside:
                end -= 1
            return [s[:end], *s[end:]]
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in inside:
                out.append(s[at:i])
                at = i
        return [*out, s[at:]]

    def _part(self, s: str) -> bytes:
        have = self.new.get(s)
        if have is None:
            have = array("H", self.model.chunk(s)).tobytes()
            self._keep(s, have)
        return have

    def _keep(self, s: str, ids: bytes) -> None:
        if len(s) <= CACHE_LETTERS:
            if len(self.new) >= CACHE_ENTRIES:
                self.old, self.new = self.new, {}
            self.new[s] = ids


@cache
def _chunks(model_file: str) -> Chunks:
    return Chunks(encoder(model_file))


def split(text: str) -> Iterator[str]:
    """Chunks that no token crosses: they begin at a line end, or where space marks follow something else."""
    if not text:
        return
    for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
        if k:
            yield "\n"
        marks = -1 if k else 0
        for part in line.split(" "):
            marks += 1
            if part:
                yield SPACE + part if marks == 1 else SPACE * marks + part
                marks = 0
        if marks:
            yield SPACE * marks


def encode(text: str, chunks: Chunks) -> np.ndarray:
    get = chunks.get
    return np.frombuffer(b"".join([get(s) for s in split(text)]), np.uint16)


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string.

    The ids are those of the sentencepiece library without begin and end ids,
    and the text that of its decode(ids). Null and empty texts have no ids and
    decode to an empty text. Rows are independent: repeated rows give repeated
    results, an empty table none; other columns are ignored. Time and memory
    grow with a text's length, whether it has blanks or not.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(model_file)
        for batch in batches:
            for part in slices(batch, 1, ROWS_OUT):
                got = [encode(t or "", chunks) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got).astype(np.int32)))
                decoded = pa.array([chunks.model.decode(g.tolist()) for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")
