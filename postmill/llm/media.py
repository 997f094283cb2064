"""Operator 7, media columns: WAV bytes, spectra and peak-pair fingerprints.

A payload is stored losslessly as 8-bit mono samples of a WAV file by the
``wave`` module.  Features come from the stored bytes, read back: a
short-time Fourier transform of half-overlapping Hann windows, the last one
filled with silence, so that no sample is left out; the strongest
local peaks of each frame, and hashes of peak pairs (frequency, frequency,
time between) with the time of the first, the fingerprint that a matcher joins
on.  The job is one narrow stage; a recording is worked through in stretches
of frames, so that memory is bounded by the payload itself.

Defined results: null text counts as empty and gives 64 zero bytes; a null
doc_id stays null; a very long text is one recording, read whole; equal texts
give equal values; repeated rows are each returned; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents

RATE, FRAME, HOP, PEAKS, FAN, STRETCH = 8000, 256, 128, 2, 3, 4096
UNIT = 64

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a WAV file; the pad byte of an odd count is not one."""
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of each frame's strongest local
    maxima, in time order (lower bin first on ties)."""
    samples = np.append(samples, np.full(max(FRAME - len(samples), (FRAME - len(samples)) % HOP), 128, np.uint8))  # silence up to the last frame's end
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    times, bins = [], []
    for start in range(0, len(frames), STRETCH):
        part = (frames[start : start + STRETCH].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))
        inner = power[:, 1:-1]
        local = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        strongest, real, row = np.empty((len(part), PEAKS), np.int64), np.empty((len(part), PEAKS), bool), np.arange(len(part))
        for k in range(PEAKS):
            strongest[:, k] = local.argmax(1)  # the first of equals
            real[:, k] = local[row, strongest[:, k]] > 1e-3
            local[row, strongest[:, k]] = -1
        order = strongest.argsort(1)
        strongest, real = np.take_along_axis(strongest, order, 1), np.take_along_axis(real, order, 1)
        at = np.broadcast_to(np.arange(start, start + len(part))[:, None], strongest.shape)
        times.append(at[real])
        bins.append(strongest[real] + 1)
    return np.concatenate(times), np.concatenate(bins)


def pair_codes(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded fingerprints: 32 bits of time over 8 + 8 + 6 bits of the
    pair's bins and distance, for each peak and its next ``FAN`` peaks."""
    found = []
    for k in range(1, FAN + 1):
        if len(times) > k:
            gap = times[k:] - times[:-k]
            near = gap < 64
            code = (bins[:-k].astype(np.int64) << 14) | (bins[k:].astype(np.int64) << 6) | gap
            found.append(((times[:-k].astype(np.int64) << 32) | code)[near])
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def fingerprint(samples: bytes) -> np.ndarray:
    return pair_codes(*peaks(np.frombuffer(samples, np.uint8)))


def media_columns(docs: DataFrame, with_media: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media (WAV file), payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, fingerprint (array of time-coded
    pairs), feature (digest of the fingerprint and its size)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for t in block.column("text"):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                stored = to_wav(padded(raw))
                back = from_wav(stored)
                pairs = fingerprint(back)
                out.append((
                    len(raw), stored if with_media else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(),
                    pairs if with_media else None, f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}",
                ))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], names)

    schema = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>, feature string"
    names = [part.split()[0] for part in schema.split(", ")]
    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), with_media=False).drop("media", "fingerprint")
