"""Audio features: lossless 8-bit storage, polyphase resampling, log-mel tensors, energy segments.

A payload is stored as a mono 8-bit PCM WAV file. Features are computed from
the samples of the file read back: resampling from 24 to 16 kHz with a
two-phase filter, overlapped log-mel frames in tensors of one fixed shape, and
segments of activity by energy with hysteresis. Every document is handled by
itself in one task, so nothing is shuffled and equal texts give equal bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.llm.memory import slices, small_batches, tidy

BLOCK, BLANK = 192, 32
HEADER = 44
ROWS_OUT = 256
OUT = "n_bytes long, media binary, payload binary, tensors binary, n_frames int, n_segments int"


@dataclass(frozen=True)
class Audio:
    rate: int = 24_000
    up: int = 2
    down: int = 3
    taps: int = 16  # of each phase
    frame: int = 400
    hop: int = 160
    fft: int = 512
    mels: int = 40
    frames_per_tensor: int = 16
    rise: float = 0.5  # standard deviations of the log energy above its mean that open a segment
    fall: float = -0.5  # and that close it

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def wav(payload: bytes, rate: int) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The sample bytes of such a file."""
    riff, _, kind = struct.unpack_from("<4sI4s", media)
    if (riff, kind) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAVE file")
    at = 12
    while True:
        tag, n = struct.unpack_from("<4sI", media, at)
        if tag == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


@cache
def phases(a: Audio) -> np.ndarray:
    """A windowed-sinc low-pass, dealt over the phases: row p holds taps p, p + up, ..."""
    n = a.up * a.taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(a.up, a.down)
    h = np.sinc(cut * t) * cut * np.hamming(n) * a.up
    return np.ascontiguousarray(h.reshape(a.taps, a.up).T[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray, a: Audio) -> np.ndarray:
    """x at rate * up / down; output n uses phase n * down mod up at input n * down div up."""
    n_out = max(1, len(x) * a.up // a.down)
    padded = np.concatenate([np.zeros(a.taps - 1, np.float32), x, np.zeros(a.down, np.float32)])
    seen, out = sliding_window_view(padded, a.taps), np.empty(n_out, np.float32)
    for first in range(a.up):
        k = len(range(first, n_out, a.up))
        if k:
            out[first :: a.up] = seen[first * a.down // a.up :: a.down][:k] @ phases(a)[first * a.down % a.up]
    return out


@cache
def mel_bank(a: Audio) -> np.ndarray:
    """Triangular filters, evenly spaced in mels, as (fft bins, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(a.out_rate / 2), a.mels + 2) / 2595) - 1)
    f = np.arange(a.fft // 2 + 1) * a.out_rate / a.fft
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _window(a: Audio) -> np.ndarray:
    return np.hanning(a.frame).astype(np.float32)


def log_mel(x: np.ndarray, a: Audio) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) log energies, and the log energy of each frame; the end is padded to whole frames."""
    n = 1 + max(0, -(-(len(x) - a.frame) // a.hop))
    x = np.concatenate([x, np.zeros((n - 1) * a.hop + a.frame - len(x), np.float32)]) if len(x) < (n - 1) * a.hop + a.frame else x
    frames, mel, energy = sliding_window_view(x, a.frame)[:: a.hop][:n], np.empty((n, a.mels), np.float32), np.empty(n, np.float32)
    for i in range(0, n, 1024):  # bounded memory for very long documents
        part = frames[i : i + 1024] * _window(a)
        power = np.abs(np.fft.rfft(part, a.fft)).astype(np.float32) ** 2
        mel[i : i + 1024] = np.log(power @ mel_bank(a) + np.float32(1e-6))
        energy[i : i + 1024] = np.log((part**2).sum(axis=1) + np.float32(1e-6))
    return mel, energy


def segments(energy: np.ndarray, a: Audio) -> np.ndarray:
    """(n, 2) frame spans that open above the upper threshold and close below the lower one."""
    mean, spread = energy.mean(), energy.std()
    mark = np.where(energy > mean + a.rise * spread, 1, np.where(energy < mean + a.fall * spread, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def tensor_file(mel: np.ndarray, spans: np.ndarray, a: Audio) -> bytes:
    """An Arrow stream with a row per tensor: start_ms, end_ms, frames that are not padding, active frames, tensor."""
    k = a.frames_per_tensor
    n = -(-len(mel) // k)
    body = np.zeros((n * k, a.mels), np.float16)
    body[: len(mel)] = mel
    active = np.zeros(n * k + 1, np.int32)
    np.add.at(active, spans[:, 0], 1)
    np.add.at(active, spans[:, 1], -1)
    active = np.cumsum(active[:-1]).reshape(n, k).sum(axis=1)
    full = np.minimum(k, len(mel) - k * np.arange(n))
    start = np.arange(n) * k * a.hop * 1000 / a.out_rate
    end = start + ((full - 1) * a.hop + a.frame) * 1000 / a.out_rate
    tensor = pa.ExtensionArray.from_storage(_tensor_type(a), pa.FixedSizeListArray.from_arrays(pa.array(body.reshape(-1)), k * a.mels))
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(full.astype(np.int32)), pa.array(active.astype(np.int32)), tensor], names=["start_ms", "end_ms", "frames", "active", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@cache
def _tensor_type(a: Audio):
    return pa.fixed_shape_tensor(pa.float16(), [a.frames_per_tensor, a.mels])


def features(text: str | None, a: Audio) -> tuple[int, bytes, bytes, bytes, int, int]:
    raw = (text or "").encode()
    media = wav(raw + bytes([BLANK]) * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), a.rate)
    payload = samples(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, a), a)
    spans = segments(energy, a)
    return len(raw), media, payload, tensor_file(mel, spans, a), len(mel), len(spans)


def audio_features(docs: DataFrame, audio: Audio = Audio()) -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload (read back), tensors (Arrow stream), n_frames, n_segments.

    Null texts are empty; an empty text is one block of blanks. Repeated rows
    give repeated results, an empty table none; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, ROWS_OUT):
                cols = list(zip(*(features(t, audio) for t in part.column(1).to_pylist())))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "media", "payload", "tensors", "n_frames", "n_segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, {OUT}")
