"""Audio columns: texts' bytes stored as sound, and features computed from what is read back.

The payload (bytes, zeros up to a positive multiple of 64) is stored as 8-bit
mono samples of RATE Hz in a RIFF/WAVE container, one byte a sample, so nothing
is lost. Reading parses the container again. Features: polyphase resampling by
UP/DOWN (one filter a phase, windowed sinc), overlapped Hann frames, log-mel
filterbanks, and a segmentation by frame energy with hysteresis: a segment opens
above the upper threshold and closes below the lower one. The log-mel frames are
kept as fixed-shape Arrow tensors, [TENSOR_FRAMES, MELS] each, with the time
span that each covers, in an Arrow stream. Long sounds are worked through in
blocks of frames, so memory doesn't follow a text's length.

Defined results: null is an empty text, whose payload is 64 zeros; equal texts
give equal bytes and features; extra columns are ignored; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.llm import common

UNIT = 64
RATE = 8000
UP, DOWN = 4, 5
REACH = 8
FRAME, HOP = 256, 128
MELS = 16
TENSOR_FRAMES = 64
BLOCK_FRAMES = 4096
#: Thresholds of the segmentation, in standard deviations of the frames' energy around its mean.
OPEN, CLOSE = 0.5, -0.25
NEW_RATE = RATE * UP // DOWN


def store(payload: bytes) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples."""
    body = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + struct.pack("<4sI", b"data", len(payload))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body) + len(payload), b"WAVE") + body + payload


def read(media: bytes) -> bytes:
    """The samples of a RIFF/WAVE file of 8-bit mono samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, wide = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            wide = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if wide is None or wide[0] != 1 or wide[1] != 1 or wide[5] != 8:
                raise ValueError("not 8-bit mono samples")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase filters (inputs x phases), the frame window, and mel filters (bins x bands)."""
    span = 2 * REACH + (UP - 1) * DOWN // UP
    phases = np.zeros((span, UP))
    cutoff = 0.92 * min(1.0, UP / DOWN)
    for p in range(UP):
        t = np.arange(span) - (REACH - 1) - p * DOWN / UP
        inside = np.abs(t) <= REACH
        taper = np.where(inside, np.i0(8 * np.sqrt(np.maximum(0, 1 - (t / REACH) ** 2))) / np.i0(8.0), 0)
        own = cutoff * np.sinc(cutoff * t) * taper
        phases[:, p] = own / own.sum()
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(100), mel(NEW_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * NEW_RATE / FRAME
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME + 1)[:-1], np.maximum(0, np.minimum(rise, fall))


def resample(samples: np.ndarray, low: int, high: int) -> np.ndarray:
    """Resampled values low to high of the whole sound; silence lies around it."""
    phases, _, _ = _filters()
    first, last = low // UP, -(-high // UP)
    begin, end = first * DOWN - (REACH - 1), (last - 1) * DOWN - (REACH - 1) + len(phases)
    x = np.zeros(end - begin)
    a, b = max(begin, 0), min(end, len(samples))
    if b > a:
        x[a - begin : b - begin] = (samples[a:b].astype(float) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, len(phases))[::DOWN]
    return (windows @ phases).ravel()[low - first * UP : high - first * UP]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and each frame's energy in dB."""
    _, window, mel = _filters()
    length = -(-len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(length - FRAME) // HOP))
    out, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for low in range(0, frames, BLOCK_FRAMES):
        high = min(frames, low + BLOCK_FRAMES)
        x = resample(samples, low * HOP, (high - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(cut, axis=1)) ** 2
        out[low:high] = np.log(power @ mel + 1e-6)
        energy[low:high] = 10 * np.log10((cut**2).mean(1) + 1e-10)
    return out, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [first, last) that are loud, with hysteresis."""
    mean, spread = energy.mean(), energy.std()
    if spread < 1e-9:
        return []
    verdict = np.where(energy > mean + OPEN * spread, 1, np.where(energy < mean + CLOSE * spread, 0, -1))
    known = np.maximum.accumulate(np.where(verdict >= 0, np.arange(len(energy)), -1))
    on = np.where(known >= 0, verdict[known], 0)
    step = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS], dim_names=["frame", "mel"])
_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", _TENSOR)])


def tensors(frames: np.ndarray, seconds: float) -> bytes:
    """An Arrow stream with a row a tensor: time span, frames that count, and the frames, zeros after the last."""
    count = -(-len(frames) // TENSOR_FRAMES)
    padded = np.zeros((count * TENSOR_FRAMES, MELS), np.float32)
    padded[: len(frames)] = frames
    first = np.arange(count) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, len(frames))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), TENSOR_FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([
        pa.array(first * HOP / NEW_RATE), pa.array(np.minimum(((last - 1) * HOP + FRAME) / NEW_RATE, seconds)), pa.array((last - first).astype(np.int32)), pa.ExtensionArray.from_storage(_TENSOR, flat),
    ], schema=_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def stored(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then n_bytes of the text and media, the stored sound."""
    common.prepare(documents.sparkSession)
    frame = documents.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches, "__text"):
            raw = data.tobytes()
            media = [store(raw[a:b] + bytes(max(UNIT, b - a + -(b - a) % UNIT) - (b - a))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=[*rows.schema.names[:-1], "n_bytes", "media"])

    return frame.mapInArrow(common.released(run), frame.drop("__text").schema.add("n_bytes", "long", False).add("media", "binary", False))


def analysed(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and media, then what is read back and its features: payload_bytes, payload_sha256, tail_crc32, seconds, features (Arrow stream of tensors), segments with time spans, mel_mean."""
    frame = media.select(*keep, F.col(column).alias("media"))
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, seconds double, features binary, segments array<struct<start_s:double,end_s:double>>, mel_mean array<float>"
    columns = {
        "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "seconds": pa.float64(), "features": pa.binary(),
        "segments": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), "mel_mean": pa.list_(pa.float32()),
    }

    def features(own: bytes) -> dict:
        payload = read(own)
        samples = np.frombuffer(payload, np.uint8)
        frames, energy = log_mel(samples)
        seconds = len(samples) / RATE
        return {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "seconds": seconds, "features": tensors(frames, seconds),
            "segments": [{"start_s": a * HOP / NEW_RATE, "end_s": min(((b - 1) * HOP + FRAME) / NEW_RATE, seconds)} for a, b in segments(energy)], "mel_mean": frames.mean(0, dtype=float).astype(np.float32),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches, "media"):
            raw = data.tobytes()
            found = [features(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([f[n] for f in found], kind) for n, kind in columns.items())], names=[*rows.schema.names, *columns])

    return frame.mapInArrow(common.released(run), StructType(frame.schema.fields + StructType.fromDDL(extra).fields))
