"""Media columns: payloads as WAV samples, and spectral-peak pair fingerprints of them.

Samples are unsigned 8-bit mono, one payload byte each, so storing is lossless.
The short-time Fourier transform takes Hann-windowed frames of FRAME samples
every HOP; local maxima of the magnitude over time and frequency are peaks, and
each peak is paired with the FAN next ones within REACH frames. A pair is coded
f1 * 2^20 + f2 * 2^10 + dt and stored with the frame of its first peak.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import map_columns

UNIT = 576
RATE = 8000
FRAME = 576
HOP = 288
FAN = 3
REACH = 60
LOUD = 2.5
#: Frames transformed at once; bounds memory for any length of payload.
BLOCK = 1024


def pad_payload(raw: bytes, unit: int = UNIT, fill: int = 255) -> bytes:
    """raw with fill bytes up to a positive multiple of unit."""
    n = max(1, -(-len(raw) // unit)) * unit
    return raw + bytes([fill]) * (n - len(raw))


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getsampwidth(), r.getnchannels()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def spectrogram(samples: bytes, frame: int = FRAME, hop: int = HOP):
    """Blocks of (first frame, magnitudes); neighbouring blocks overlap by one frame at each end."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) < frame:
        x = np.concatenate([x, np.full(frame - len(x), 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    for start in range(0, len(frames), BLOCK):
        lo, hi = max(0, start - 1), min(len(frames), start + BLOCK + 1)
        block = frames[lo:hi].astype(np.float32)
        block = (block - block.mean(axis=1, keepdims=True)) * _WINDOW
        yield lo, start, min(len(frames), start + BLOCK), np.abs(np.fft.rfft(block, axis=1)).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of local maxima over the 3 x 3 neighbourhood that exceed LOUD times their frame's mean, in time order."""
    times, bins = [], []
    for lo, start, stop, mag in spectrogram(samples):
        grid = np.pad(mag, ((1, 1), (0, 0)), constant_values=-1.0)
        mid = grid[1:-1, 1:-1]
        top = (mid > grid[1:-1, :-2]) & (mid > grid[1:-1, 2:]) & (mid >= grid[:-2, 1:-1]) & (mid > grid[2:, 1:-1])
        top &= mid > LOUD * mag.mean(axis=1, keepdims=True)
        t, f = np.nonzero(top)
        keep = (t + lo >= start) & (t + lo < stop)
        times.append(t[keep] + lo)
        bins.append(f[keep] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of peak pairs, ordered by time, then code."""
    t, f = peaks(samples)
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k] if len(t) > k else np.zeros(0, np.int64)
        near = dt <= REACH
        times.append(t[: len(dt)][near])
        codes.append((f[: len(dt)][near] << 20) | (f[k:][near] << 10) | dt[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def _store(with_media: bool):
    def fn(ids, texts):
        cols = [[] for _ in range(10)]
        for doc, text in zip(ids, texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = encode_wav(pad_payload(raw))
            back = decode_wav(media)
            times, codes = fingerprint(back)
            row = (doc, len(raw), back, media if with_media else None, times.tolist() if with_media else None, codes.tolist() if with_media else None, len(media), hashlib.sha256(media).hexdigest(), f"{len(times)}:{hashlib.sha256(np.stack([times, codes]).astype('<i8').tobytes()).hexdigest()}", (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:])))
            for c, v in zip(cols, row):
                c.append(v)
        if with_media:
            return cols[0], cols[1], cols[3], cols[4], cols[5]
        return cols[0], cols[1], [d[0] for d in cols[9]], [d[1] for d in cols[9]], [d[2] for d in cols[9]], cols[6], cols[7], cols[8]

    return fn


def _full():
    return _store(True)


def _digest():
    return _store(False)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, media (WAV file), peak_times and peak_codes (arrays of equal length).

    Null and empty texts give one unit of fill bytes. Repeated rows give equal
    values. Other columns are not read, so extra columns cannot clash.
    """
    return map_columns(docs, [F.col(id_col), F.col(text_col)], _full, "doc_id long, n_bytes long, media binary, peak_times array<long>, peak_codes array<long>")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_columns reduced in the same task to sizes, hashes and a feature string, for tables that keep no media."""
    return map_columns(docs, [F.col(id_col), F.col(text_col)], _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
