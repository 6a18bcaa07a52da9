"""Media columns: audio stored losslessly, and features of it.

A clip is an 8-bit PCM WAV file in a binary column. Its features are read from
the stored bytes: a polyphase filter bank resamples it, overlapped windows
give log-mel energies, and a segmenter with two thresholds (hysteresis) gives
the time spans of sound. The log-mels are stored as fixed-shape Arrow tensors
of (FRAMES, MELS), each with its time span, in an Arrow IPC stream.

Energies are computed in 64 bits and rounded to 1 / STEPS_A_UNIT, so that they, and digests
of them, do not depend on the order in which a processor adds.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

RATE = 16_000
#: 16 kHz to 10 kHz.
UP, DOWN, TAPS = 5, 8, 16
#: Window, step and transform length in samples at 10 kHz; 25 and 10 ms.
WINDOW, STEP, FFT = 250, 100, 256
MELS, FRAMES = 24, 32
#: Decibels above the clip's quietest tenth at which sound starts and ends.
ON_DB, OFF_DB = 6.0, 3.0
#: Resampled samples worked on at a time, so that long clips need bounded memory.
CHUNK = 1 << 16
BLOCK = 576
#: Log energies are whole multiples of one over this.
STEPS_A_UNIT = 256


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """The payload with bytes 255 up to a positive multiple of block."""
    size = max(1, -(-len(payload) // block)) * block
    return payload + b"\xff" * (size - len(payload))


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono WAV file of unsigned 8-bit samples; chunks
    other than format and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _filters() -> np.ndarray:
    """(UP, TAPS): the phases of a windowed-sinc low-pass filter."""
    n = UP * TAPS
    t = (np.arange(n) - (n - 1) / 2) / max(UP, DOWN)
    h = np.sinc(t) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)])


@cache
def _mel_bank() -> np.ndarray:
    """(FFT / 2 + 1, MELS): triangular filters, evenly spaced in mel."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    freq = np.arange(FFT // 2 + 1) * rate / FFT
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    up, down = (freq[:, None] - lo) / (mid - lo), (hi - freq[:, None]) / (hi - mid)
    return np.maximum(0, np.minimum(up, down))


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate, by one filter phase for each output."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS // 2), x.astype(float), np.zeros(TAPS)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n)
    h = _filters()
    for at in range(0, n, CHUNK):
        k = np.arange(at, min(n, at + CHUNK)) * DOWN
        out[at : at + CHUNK] = np.einsum("ij,ij->i", windows[k // UP], h[k % UP])
    return out


def log_mels(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) float32 log energies of overlapped windows; at least one
    frame, short input is padded with silence."""
    if len(y) < WINDOW:
        y = np.concatenate([y, np.zeros(WINDOW - len(y))])
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::STEP]
    taper, bank, out = np.hanning(WINDOW), _mel_bank(), []
    for at in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * taper, FFT)) ** 2
        out.append(np.rint(np.log(power @ bank + 1e-6) * STEPS_A_UNIT) / STEPS_A_UNIT)
    return np.concatenate(out).astype(np.float32)


def segments(mels: np.ndarray) -> list[tuple[float, float]]:
    """(start, end) in seconds: sound starts where the energy rises ON_DB above
    the quietest tenth of frames and ends where it falls below OFF_DB."""
    db = np.round(10 * np.log10(np.exp(mels.astype(float)).sum(1) + 1e-6), 6)
    floor = np.sort(db)[len(db) // 10]
    state = np.where(db >= floor + ON_DB, 1, np.where(db < floor + OFF_DB, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    second = STEP * DOWN / UP / RATE
    return [(float(a * second), float(b * second)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def tensors(mels: np.ndarray) -> pa.RecordBatch:
    """start, end (seconds) and mel: fixed-shape tensors (FRAMES, MELS); the
    last is filled up with its lowest value."""
    n = -(-len(mels) // FRAMES)
    full = np.full((n * FRAMES, MELS), mels.min(), np.float32)
    full[: len(mels)] = mels
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, MELS))
    second = STEP * DOWN / UP / RATE
    start = np.arange(n) * FRAMES * second
    return pa.record_batch({"start": start, "end": np.minimum(start + FRAMES * second, len(mels) * second), "mel": array})


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def features(media: bytes) -> tuple[list[tuple[float, float]], bytes]:
    """(segments, tensors as an Arrow IPC stream) of a stored clip."""
    _, samples = decode_wav(media)
    mels = log_mels(resample((np.frombuffer(samples, np.uint8).astype(float) - 128) / 128))
    return segments(mels), to_ipc(tensors(mels))


SCHEMA = "n_bytes long, media binary, segments array<struct<start: double, end: double>>, tensors binary"


def audio_column(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (of the text), media (a WAV file of the padded text),
    segments and tensors for each row. A null text counts as empty and gives
    one block of padding; long texts are stored and resampled whole; rows may
    repeat, and ids may be null; equal texts have equal values."""
    return _rows(docs, text, id_col, SCHEMA, lambda n, media, segs, ipc: {"n_bytes": n, "media": media, "segments": [{"start": a, "end": b} for a, b in segs], "tensors": ipc})


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of what audio_column stores, made where it is stored, so that
    no media bytes leave the task. Nulls, long texts, repeated rows and ids
    are as there: each row is worked on by itself."""

    def row(n: int, media: bytes, segs: list[tuple[float, float]], ipc: bytes) -> dict:
        _, payload = decode_wav(media)
        spans = "|".join(f"{a:.3f}-{b:.3f}" for a, b in segs)
        return {
            "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"logmel{FRAMES}x{MELS}:{hashlib.sha256(ipc).hexdigest()};segments:{spans}",
        }

    return _rows(docs, text, id_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)


def _rows(docs: DataFrame, text: str, id_col: str, schema: str, row) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    names = [c.split()[0] for c in schema.replace("start: double, end: double", "").split(", ")]

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": b["doc_id"]} | {n: [] for n in names}
        for text in b["text"]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = encode_wav(pad(raw))
            for k, v in row(len(raw), media, *features(media)).items():
                out[k].append(v)
        return out

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, {schema}")
