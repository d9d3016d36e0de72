"""64-bit hashes of the words of texts, in numpy.

A word is a run of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased. Its hash
is a polynomial in a random odd base over random values of its bytes, taken
from prefix sums, so a block of text costs a few passes whatever its words are.
"""

from __future__ import annotations

import re

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0d]")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(1))
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(p)]
    return _powers


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of one block."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=upto[1:])
    return mix((upto[end] - upto[start]) * inverse[start]), start


def _cuts(data: bytes) -> list[bytes]:
    """Parts of about BLOCK bytes that break no word."""
    out, at = [], 0
    while len(data) - at > 2 * BLOCK:
        found = _BLANKS.search(data, at + BLOCK)
        if found is None:
            break
        out.append(data[at : found.start()])
        at = found.start()
    return [*out, data[at:]]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, in order."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0

    def flush():
        nonlocal block, size
        h, start = _hashes(b"\n".join(block))
        begins = np.cumsum([0, *(len(b) + 1 for b in block)])
        out.extend(np.split(h, np.searchsorted(start, begins[1:-1])) if block else [])
        block, size = [], 0

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > 2 * BLOCK:
            flush()
            out.append(np.concatenate([_hashes(part)[0] for part in _cuts(data)]))
            continue
        block.append(data)
        size += len(data) + 1
        if size > BLOCK:
            flush()
    flush()
    return out
