"""Media columns: byte payloads as 8-bit audio, with log-mel tensors and energy segments.

A payload is stored without loss as a WAV file of unsigned 8-bit samples in a binary media column.  Features come
from the stored bytes: a polyphase FIR resampler brings the samples to the analysis rate, overlapped Hann windows
go through a mel filterbank, the log-mel frames are cut into windows of fixed shape, each with its time span, and
hysteresis on the frames' energy (one threshold to open a segment, a lower one to close it) gives the segments'
spans.  A payload's windows are stored as Arrow fixed-shape tensors, an IPC stream in a binary column.  Each item
is processed alone and in pieces that start at fixed places, so equal payloads give equal values.

Nulls and edge cases: a null or empty text is a payload of 64 zero bytes; a very long text is one row with as many
windows as it needs, resampled a piece at a time; equal rows give equal rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch
from tidelog.llm.textops import slices

#: Stored rate, and the resampler's ratio: 12 kHz are analysed.
RATE, UP, DOWN = 16_000, 3, 4
BLOCK = 64
FRAME, HOP, MELS = 256, 128, 24
#: Shape of a tensor: frames of a window by mel bands.
WINDOW = 64
#: Frames resampled and transformed at a time: whole windows.
PIECE = 32 * WINDOW
#: Time bins of the digest.
TIME_BINS = 8
TAPS = 16
#: Decibels over the median frame that open a segment, and below which it closes; shortest segment in frames.
OPEN_DB, CLOSE_DB, MIN_FRAMES = 0.75, 0.0, 2
#: Added to the power before its logarithm, and so the value of frames past the payload's end.
FLOOR = 1e-6


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and those bytes with zeros up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return len(raw), raw.ljust(size, b"\0")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples) + len(pad), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def polyphase_filter(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """One row of coefficients for each phase of a Hamming-windowed low-pass."""
    n = up * taps * max(1, down // up)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(-1, up).T[:, ::-1].astype(np.float32).copy()


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Outputs start to stop of 8-bit samples at up/down (in lowest terms) times their rate.

    Output k takes phase ``k * down % up`` of the filter around sample ``k * down // up``; samples outside are silence.
    """
    phases = polyphase_filter(up, down)
    size = phases.shape[1]
    stop = -(-len(samples) * up // down) if stop is None else stop
    first, last = start * down // up, (stop - 1) * down // up
    low, high = first - size // 2, last - size // 2 + size
    held = samples[max(low, 0) : high]
    part = np.zeros(high - low, np.float32)
    part[max(low, 0) - low :][: len(held)] = (held.astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, size)
    out = np.empty(stop - start, np.float32)
    for k in range(start, min(start + up, stop)):
        own = out[k - start :: up]
        own[:] = np.ascontiguousarray(windows[k * down // up - first :: down][: len(own)]) @ phases[k * down % up]
    return out


@functools.cache
def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the frame's spectrum."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    freq = np.arange(frame // 2 + 1) * rate / frame
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_window = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frame_count(size: int) -> int:
    """Half-overlapped frames that cover so many samples, the last one zero-padded."""
    return max(1, -(-(size - FRAME) // HOP) + 1)


def log_mel(samples: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames of the resampled samples and each frame's energy in decibels, PIECE frames at a time."""
    size = -(-len(samples) * UP // DOWN)
    count = frame_count(size)
    mel, energy = np.empty((count, MELS), np.float32), np.empty(count, np.float32)
    for at in range(0, count, PIECE):
        stop = min(count, at + PIECE)
        x = np.zeros((stop - at - 1) * HOP + FRAME, np.float32)
        made = resample(samples, UP, DOWN, at * HOP, min(size, at * HOP + len(x)))
        x[: len(made)] = made
        part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _window
        spectrum = np.fft.rfft(part, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at:stop] = np.log10(power @ mel_bank(rate) + FLOOR)
        energy[at:stop] = 10 * np.log10((part**2).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open at OPEN_DB over the median and close below CLOSE_DB over it."""
    level = np.round(energy - np.median(energy), 3)
    state = np.where(level >= OPEN_DB, 1, np.where(level < CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], (last >= 0) & (state[np.maximum(last, 0)] > 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= MIN_FRAMES]


#: Half precision keeps three digits of a logarithm, and half the bytes.
KIND = pa.fixed_shape_tensor(pa.float16(), [WINDOW, MELS], dim_names=["time", "mel"])
WINDOWS = pa.schema([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("log_mel", KIND)])


def store_windows(mel: np.ndarray, step: float, length: float) -> bytes:
    """An IPC stream with a row for each WINDOW frames: span in milliseconds and tensor.  Past the last frame is the floor."""
    count = -(-len(mel) // WINDOW)
    padded = np.full((count * WINDOW, MELS), math.log10(FLOOR), np.float16)
    padded[: len(mel)] = mel
    tensors = pa.ExtensionArray.from_storage(KIND, pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), WINDOW * MELS))
    starts = np.arange(count) * (WINDOW * step)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WINDOWS) as out:
        out.write_batch(pa.record_batch([pa.array(starts), pa.array(np.minimum(starts + WINDOW * step, length)), tensors], schema=WINDOWS))
    return sink.getvalue().to_pybytes()


def read_windows(stored: bytes) -> pa.Table:
    """start_ms, end_ms, log_mel (fixed-shape tensors) of a stored column's value."""
    return pa.ipc.open_stream(stored).read_all()


def describe(samples: bytes, rate: int) -> tuple[bytes, list[tuple[float, float]], str]:
    """The stored windows, the segments' spans in milliseconds and the digest."""
    mel, energy = log_mel(np.frombuffer(samples, np.uint8), rate * UP / DOWN)
    step = HOP * 1000 * DOWN / (rate * UP)
    found = segments(energy)
    edges = np.arange(TIME_BINS + 1) * len(mel) / TIME_BINS
    means = np.stack([mel[int(a) : max(int(a) + 1, int(np.ceil(b)))].mean(axis=0) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    # log-mel means of the time bins in steps of 1/32 decade from the floor on, one byte each, then the numbers of segments and windows
    digest = f"{np.clip(np.round((means + 6) * 32), 0, 255).astype(np.uint8).tobytes().hex()}:{len(found)}:{-(-len(mel) // WINDOW)}"
    return store_windows(mel, step, len(samples) * 1000 / rate), [(a * step, b * step) for a, b in found], digest


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV file) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [payload_of(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


SPANS = "array<struct<start_ms:double,end_ms:double>>"


def features(media: DataFrame) -> DataFrame:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, windows, spans and a digest (feature) from stored media."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, windows binary, spans {SPANS}, feature string"
    kind = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows, windows, spans, digests = [], [], [], []
                for held in part.column("media").to_pylist():
                    rate, samples = from_wav(held)
                    stored, found, digest = describe(samples, rate)
                    windows.append(stored), digests.append(digest), spans.append([{"start_ms": a, "end_ms": b} for a, b in found])
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(held), hashlib.sha256(held).hexdigest()))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *columns, pa.array(windows, pa.binary()), pa.array(spans, kind), pa.array(digests)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "windows", "spans", "feature"])

    return media.mapInArrow(run, schema)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the media column in the shared folder, reads it back, and returns its features as they are stored in their turn."""
    scratch = Scratch(docs.sparkSession, "audio")
    media = scratch.keep(media_column(docs, id_col, text_col), "media")
    return scratch.finish(features(media), "features")
