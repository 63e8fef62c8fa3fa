"""Audio columns: lossless 8-bit samples, resampling, log-mel filterbanks, energy segments.

A text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are the samples of an
8-bit mono WAV file. Features are computed from the bytes read back from that file:
polyphase resampling by UP / DOWN (one short filter per phase), frames of FRAME samples every HOP, log-mel
energies in MELS bands, and segments by hysteresis (a segment opens at the upper energy
threshold and closes below the lower one). Frames are stored as fixed-shape Arrow tensors of SHAPE
(the last one filled with the floor), each with its time span, in one Arrow stream per row.

Null texts count as empty: 64 zero bytes. Equal texts give equal values, as each row is computed by
itself; repeated rows repeat them. Long texts are resampled and transformed in blocks. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import documents, flat

UNIT = 64
RATE, UP, DOWN, TAPS = 8_000, 3, 4, 12
FRAME, HOP, MELS = 256, 160, 24
SHAPE = (32, MELS)
FLOOR = -10.0
BLOCK = 8_192


def to_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples expected")
        return w.readframes(w.getnframes())


@functools.cache
def phases() -> np.ndarray:
    """Filter taps per phase: a windowed sinc below the lower of the two Nyquist rates."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(t / DOWN) * np.kaiser(len(t), 6.0)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Output m is phase (m * DOWN) % UP over the TAPS inputs that end at (m * DOWN) // UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(1, np.float32)))
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for p in range(UP):
        at = p * DOWN // UP
        taps = phases()[p * DOWN % UP]
        count = len(range(p, n, UP))
        for lo in range(0, count, BLOCK * 8):
            hi = min(count, lo + BLOCK * 8)
            out[p + UP * lo : p + UP * (hi - 1) + 1 : UP] = windows[at + DOWN * lo : at + DOWN * (hi - 1) + 1 : DOWN] @ taps
    return out


@functools.cache
def mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@functools.cache
def hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x bands, natural log with a floor."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.concatenate((x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)))
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((frames, MELS), np.float32)
    for lo in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(view[lo : lo + BLOCK] * hann(), axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[lo : lo + BLOCK] = np.maximum(FLOOR, np.log(power.astype(np.float32) @ mel_bank() + 1e-12))
    return out


def segments(mel: np.ndarray) -> np.ndarray:
    """First and last + 1 frame of each segment. Thresholds follow the row's mean energy and its spread."""
    e = mel.mean(axis=1)
    mean, spread = float(e.mean()), float(e.std())
    state = np.where(e >= mean + 0.25 * spread, 1, np.where(e < mean - 0.25 * spread, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(e)), -1))
    on = np.concatenate(([0], np.where(known >= 0, state[np.maximum(known, 0)] > 0, False).astype(np.int8), [0]))
    return np.flatnonzero(np.diff(on)).reshape(-1, 2)


def seconds(frame) -> float:
    return float(frame) * HOP * DOWN / UP / RATE


def tensors(mel: np.ndarray) -> np.ndarray:
    count = -(-len(mel) // SHAPE[0])
    out = np.full((count * SHAPE[0], MELS), FLOOR, np.float32)
    out[: len(mel)] = mel
    return out.reshape(count, *SHAPE)


def to_arrow(blocks: np.ndarray, frames: int) -> bytes:
    """An Arrow stream: start_s, end_s, frames, mel (a fixed-shape tensor)."""
    first = np.arange(len(blocks)) * SHAPE[0]
    last = np.minimum(first + SHAPE[0], frames)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(first * HOP * DOWN / UP / RATE), pa.array(((last - 1) * HOP + FRAME) * DOWN / UP / RATE), pa.array((last - first).astype(np.int32)), pa.FixedShapeTensorArray.from_numpy_ndarray(blocks)],
        names=["start_s", "end_s", "frames", "mel"],
    )
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def from_arrow(raw: bytes) -> tuple[np.ndarray, pa.RecordBatch]:
    batch = pa.ipc.open_stream(raw).read_next_batch()
    return batch.column("mel").to_numpy_ndarray(), batch


def audio_columns(docs: DataFrame, with_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames,
    segments, feature and, with_media, media, tensors (an Arrow stream) and spans (start_s, end_s). Media, tensors and spans
    are always made and read back; with_media only says whether they are handed on."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames int, segments int, feature string"
    schema += ", media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>" * with_media

    def one(text: np.ndarray):
        raw = text.tobytes()
        media = to_wav(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
        payload = from_wav(media)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mel = log_mel(resample(x))
        parts = segments(mel)
        spans = [{"start_s": seconds(a), "end_s": seconds(b)} for a, b in parts]
        stored = to_arrow(tensors(mel), len(mel))
        # The feature is that of the tensors read back.
        blocks, batch = from_arrow(stored)
        frames = int(np.sum(batch.column("frames").to_numpy()))
        mean = float(blocks.reshape(-1, MELS)[:frames].mean())
        feature = f"f{frames} t{len(blocks)} s{len(spans)} e{mean:.2f} c{zlib.crc32(np.round(blocks * 16).astype('<i2').tobytes()):08x}"
        row = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), len(parts), feature]
        return row + [media, stored, spans] * with_media

    def run(stream):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "segments", "feature"]
        if with_media:
            types += [pa.binary(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
            names += ["media", "tensors", "spans"]
        for batch in stream:
            data, at = flat(batch.column("text"))
            step = 64 if with_media else batch.num_rows
            for lo in range(0, batch.num_rows, max(1, step)):
                rows = [one(data[at[i] : at[i + 1]]) for i in range(lo, min(lo + step, batch.num_rows))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo : lo + step], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)
