"""Operator 7: media columns. Bytes are kept as 8-bit mono WAV and read back by the wave module.

The stored form is a binary column of a table in the shared folder; features are computed from what is
read back. A short-time Fourier transform (Hann frames of 256 samples, hop 64, each frame without its mean)
gives the strongest local maxima of each frame. The payload is closed into a ring, so that its first and last
bytes weigh as much as the others. Each peak is paired with the following peaks of later frames in a target
zone, and the pairs are kept as arrays of (time, frequency, frequency, time difference), times in hops.
Rows are independent, batches are cut by
bytes, very long payloads are transformed in stretches, and nothing is shuffled.

Defined results: a null text is empty; an empty payload is padded to one unit; equal texts, and rows that repeat,
give equal media and features; of peaks that tie, the lower bin counts; a payload of one byte value is silent
and has the one pair (0, 0, 0, 0); a null doc_id stays null; with no rows the result is empty; other columns
are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

UNIT, RATE = 192, 8000
#: UNIT is a multiple of HOP. PEAKS a frame; FAN following peaks within ZONE hops; a peak has FLOOR of the frame's largest.
FRAME, HOP, PEAKS, FAN, ZONE, FLOOR = 256, 64, 4, 4, 16, 0.05
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)
PAIR = pa.struct([("t", pa.int32()), ("f1", pa.int32()), ("f2", pa.int32()), ("dt", pa.int32())])
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
PAIRS = "pairs array<struct<t:int,f1:int,f2:int,dt:int>>"


def to_wav(data: bytes, unit: int = UNIT, pad: bytes = b" ") -> bytes:
    """The bytes, padded to a positive multiple of ``unit``, as 8-bit mono samples."""
    data += pad * (-len(data) % unit or (unit if not data else 0))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(payload: bytes, chunk: int = 4096) -> np.ndarray:
    """(time, frequency bin) of the strongest local maxima of each frame, by time and bin; ties: the first."""
    samples = np.frombuffer(payload, np.uint8)
    n = len(samples) // HOP
    ring = np.concatenate((samples, np.resize(samples, FRAME - HOP)))
    out = []
    for i in range(0, n, chunk):
        part = ring[i * HOP : (min(i + chunk, n) - 1) * HOP + FRAME].astype(np.float32)
        part = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        part = part - (part @ _HANN / _HANN.sum())[:, None]
        spectrum = np.abs(np.fft.rfft(part * _HANN, axis=1)).round(3)
        inner = spectrum[:, 1:-1]
        top = (inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]) & (inner >= FLOOR * inner.max(axis=1, keepdims=True))
        left, rows = np.where(top, inner, 0), np.arange(len(inner))
        picked = np.zeros(inner.shape, dtype=bool)
        for _ in range(PEAKS):
            best = left.argmax(axis=1)
            picked[rows, best] = left[rows, best] > 0
            left[rows, best] = 0
            if not left.any():
                break
        frame, bin_ = np.nonzero(picked)
        out.append(np.stack([frame + i, bin_ + 1], axis=1))
    return np.concatenate(out)


def fingerprint(payload: bytes) -> np.ndarray:
    """Peak pairs (t, f1, f2, dt), by time; each peak with the next FAN ones of later frames in the target zone."""
    found = peaks(payload)
    time = found[:, 0]
    second = np.searchsorted(time, time, side="right")[:, None] + np.arange(FAN)
    first = np.repeat(np.arange(len(found)), FAN)
    second = second.ravel()
    inside = second < len(found)
    first, second = first[inside], second[inside]
    inside = time[second] - time[first] <= ZONE
    first, second = first[inside], second[inside]
    if not len(first):
        return np.zeros((1, 4), dtype=np.int64)
    return np.stack([time[first], found[first, 1], found[second, 1], time[second] - time[first]], axis=1)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in text_slices(batch.column(1)):
            ids, texts = batch.column(0)[i:j], batch.column(1)[i:j].cast(pa.binary()).to_pylist()
            yield pa.record_batch([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wav(x) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in text_slices(batch.column(2)):
            part = batch.slice(i, j - i)
            media = part.column(2).to_pylist()
            payloads = [from_wav(x) for x in media]
            prints = [fingerprint(x) for x in payloads]
            flat = np.concatenate(prints).astype(np.int32)
            offsets = pa.array(np.cumsum([0] + [len(x) for x in prints]), pa.int32())
            if as_text:
                pairs = pc.binary_join_element_wise(*[pc.cast(pa.array(flat[:, k]), pa.string()) for k in range(4)], ":")
                found = pc.binary_join(pa.ListArray.from_arrays(offsets, pairs), ",")
            else:
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], fields=list(PAIR)))
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(x) for x in payloads], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                    pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    found,
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature" if as_text else "pairs"],
            )


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the WAV, as a table in the shared folder."""
    return written(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_store, STORED))


def features(media: DataFrame, as_text: bool = False) -> DataFrame:
    """Features of stored media, from the bytes read back; as_text: the pairs as ``feature``, t:f1:f2:dt, comma-joined."""
    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(lambda batches: _features(batches, as_text), f"{FEATURES}, " + ("feature string" if as_text else PAIRS))
