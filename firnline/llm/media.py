"""Audio features of byte payloads that are stored losslessly as 8-bit samples.

A payload is the UTF-8 text, padded with bytes 0 to a positive multiple of 64, and stored
as a mono 8-bit WAV file. Features come from the bytes that are read back: polyphase
resampling, overlapped log-mel bands, energy segments with hysteresis. Each row carries
a fixed-shape tensor (``SLICES`` x ``BANDS``) with the time span of each slice.

Nulls count as empty texts (one block of 64 zero bytes). Equal texts give equal values, and repeated rows a row each; a constant
signal is one segment. Very long texts are stored and measured whole, frames in strips. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import id_text

PAD, RATE = 64, 8000
UP, DOWN, TAPS = 3, 4, 16  # resampled to RATE * UP / DOWN; taps for each phase
FRAME, HOP, BANDS, SLICES = 256, 128, 24, 16
#: Segments open at the first and close at the second of these quantile-based levels.
OPEN, CLOSE = 0.7, 0.5

SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensor array<float>, slice_spans array<float>, segments array<struct<start:float,end:float>>, frames int"


def store(payload: bytes) -> bytes:
    """A WAV file of 8-bit unsigned mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def load(media: bytes) -> bytes:
    """The samples of such a file, by walking its chunks."""
    at = 12
    while True:
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def padded(text: bytes) -> bytes:
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


@lru_cache(maxsize=1)
def _prototype() -> np.ndarray:
    """Low-pass filter at the narrower of the two bands, row p for phase p."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    return (UP * cut * np.sinc(cut * t) * np.hamming(n)).reshape(TAPS, UP).T.astype(np.float32).copy()


def resample(x: np.ndarray) -> np.ndarray:
    """Rate times UP / DOWN; each output phase filters only the samples that it needs."""
    bank = _prototype()
    n = -(-len(x) * UP // DOWN)
    y = np.empty(n, np.float32)
    held = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(held, TAPS)
    for p in range(UP):
        m = len(range(p, n, UP))
        y[p::UP] = windows[p * DOWN // UP :: DOWN][:m] @ bank[(p * DOWN) % UP][::-1]
    return y


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, BANDS), frames of FRAME samples that overlap by FRAME - HOP; the last is filled up with zeros."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    held = np.zeros((n - 1) * HOP + FRAME, np.float32)
    held[: len(y)] = y
    weights, window = _mel()
    out = np.empty((n, BANDS), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP]
    for i in range(0, n, 2048):
        spectrum = np.fft.rfft(frames[i : i + 2048] * window, axis=1)
        out[i : i + 2048] = np.log((spectrum.real**2 + spectrum.imag**2) @ weights + 1e-6)
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """(start, end) frames of runs above the lower level that reach the upper one."""
    low, high = np.quantile(energy, (CLOSE, OPEN))
    on = np.concatenate([[False], energy >= low, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    if not len(edges):
        return edges
    return edges[np.maximum.reduceat(np.append(energy, -np.inf), edges.ravel())[::2] >= high]


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Tensor, slice bounds in seconds, segments in seconds, number of frames."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels = log_mel(resample(x))
    step = HOP / (RATE * UP / DOWN)
    bounds = np.linspace(0, len(mels), SLICES + 1)
    lo = np.minimum(bounds[:-1].astype(int), len(mels) - 1)
    hi = np.maximum(np.ceil(bounds[1:]).astype(int), lo + 1)
    sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mels, axis=0, dtype=np.float64)])
    tensor = ((sums[hi] - sums[lo]) / (hi - lo)[:, None]).astype(np.float32)
    return tensor, (bounds * step).astype(np.float32), segments(mels.mean(axis=1)) * step, len(mels)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "tensor", "slice_spans", "segments", "frames"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.struct([("start", pa.float32()), ("end", pa.float32())])), pa.int32()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            media = store(padded(raw))
            payload = load(media)
            tensor, spans, parts, frames = features(payload)
            rows.append((doc_id.as_py(), len(raw), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), tensor.ravel(), spans, [{"start": a, "end": b} for a, b in parts.tolist()], frames))
            held += len(media)
            if held > 4_000_000:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def audio_features(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: the stored file, its read-back digests, tensor and time spans."""
    return id_text(docs).mapInArrow(_rows, SCHEMA)


def tensor_column(rows: pa.Table) -> pa.Table:
    """The result as Arrow with ``tensor`` as a fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SLICES, BANDS))
    flat = rows.column("tensor").combine_chunks().flatten()
    held = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), SLICES * BANDS))
    return rows.set_column(rows.schema.get_field_index("tensor"), pa.field("tensor", kind), held)


def describe(tensor: np.ndarray, spans: list, segments: list, frames: int) -> str:
    """A row's features as one short line of JSON: the bands' means, the slices' bounds, and a digest of the whole tensor in hundredths."""
    mean = np.asarray(tensor, np.float64).mean(axis=0)
    whole = np.rint(np.asarray(tensor, np.float64) * 100).astype("<i4").tobytes()
    line = {"frames": frames, "mel": [round(float(v), 2) + 0.0 for v in mean], "slices": [round(v, 3) for v in spans], "tensor": hashlib.sha256(whole).hexdigest()[:32]}
    return json.dumps({**line, "segments": [[round(s["start"], 3), round(s["end"], 3)] for s in segments]}, separators=(",", ":"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tensors = [t for c in tensor_column(pa.Table.from_batches([b])).column("tensor").chunks for t in c.to_numpy_ndarray()]
        rows = b.select(["slice_spans", "segments", "frames"]).to_pylist()
        line = pa.array([describe(t, r["slice_spans"], r["segments"], r["frames"]) for t, r in zip(tensors, rows, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(7)), line], names=[*b.schema.names[:7], "feature"])


def digests(rows: DataFrame) -> DataFrame:
    """The rows of ``audio_features`` with the file replaced by its length and SHA-256, and the features by one line."""
    kept = rows.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "cast(octet_length(media) AS long) AS media_bytes", "sha2(media, 256) AS media_sha256", "tensor", "slice_spans", "segments", "frames")
    return kept.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
