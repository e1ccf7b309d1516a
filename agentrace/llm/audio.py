"""Media columns: texts as lossless 8-bit WAV audio, and features read back from the stored bytes.

The features are a polyphase resampling, overlapped log-mel filterbanks and segments of loud frames
found with two thresholds. Filterbanks are kept as Arrow fixed-shape tensors, each row of which
names the span of time that it covers.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.llm.batches import fields, map_slices
from agentrace.llm.registry import query, table

#: Payloads end with this byte up to a positive multiple of the unit.
PAD, UNIT = 255, 576
RATE, DOWN, TAPS = 16_000, 2, 32
FRAME, HOP, MELS = 256, 128, 32
#: Frames of one tensor; the last one of a medium is filled up with the floor value.
TENSOR_FRAMES = 64
FLOOR = -8.0
#: A segment has a frame louder than its medium's median by HIGH decibels, and none below LOW.
HIGH, LOW = 1.5, 0.5
#: Frames whose spectra are held at once.
BLOCK = 4096


def payload_of(data: bytes) -> bytes:
    return data + bytes([PAD]) * (UNIT - len(data) if not data else -len(data) % UNIT)


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples; payloads here have even length."""
    head = struct.pack(
        "<4sI4s4sIHHIIHH4sI",
        b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload),
    )
    return head + payload


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a RIFF file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


@lru_cache(1)
def low_pass() -> np.ndarray:
    """A windowed sinc for the lower rate, of unit gain."""
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS)
    return h / h.sum()


def resampled(x: np.ndarray) -> np.ndarray:
    """Every DOWN-th sample of the filtered signal; each phase of the filter runs at the low rate."""
    h = low_pass()
    size = -(-len(x) // DOWN)
    out = np.zeros(size)
    padded = np.concatenate((np.zeros(TAPS), x, np.zeros(DOWN)))
    for phase in range(DOWN):
        # out[n] takes h[k] x[DOWN n - k] for k = phase, phase + DOWN, ...
        branch = padded[TAPS - phase - (TAPS // DOWN - 1) * DOWN :: DOWN][: size + TAPS // DOWN - 1]
        out += np.convolve(branch, h[phase::DOWN], "valid")
    return out


def whole_hops(x: np.ndarray) -> np.ndarray:
    """The signal with its last value held until the filter has run out and a frame ends there."""
    size = -(-len(x) // DOWN) + TAPS // DOWN
    size = max(FRAME, size + (FRAME - size) % HOP)
    return np.concatenate((x, np.full(DOWN * size - len(x), x[-1] if len(x) else 0.0)))


@lru_cache(1)
def mel_bank() -> tuple[np.ndarray, np.ndarray]:
    """The frame window and triangular filters over the bins of its spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE / DOWN
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME + 1)[:-1], np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames by bands, base-10 logarithms in hundredths; one frame at least."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x))))
    window, bank = mel_bank()
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    rows = [
        np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)) ** 2 @ bank
        for at in range(0, len(frames), BLOCK)
    ]
    power = np.log10(np.maximum(np.concatenate(rows), 10.0**FLOOR))
    return np.round(power, 2).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of frames above the low threshold that reach the high one."""
    loud = np.round(10 * mel.mean(axis=1, dtype=np.float64), 2)
    middle = np.median(loud)
    low = np.concatenate(([False], loud >= middle + LOW, [False]))
    turn = np.flatnonzero(low[1:] != low[:-1])
    high = np.concatenate(([0], np.cumsum(loud >= middle + HIGH)))
    return [(a, b) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()) if high[b] > high[a]]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors (TENSOR_FRAMES, MELS) with columns start_s, end_s."""
    count = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((count * TENSOR_FRAMES, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    step = HOP * DOWN / RATE
    start = np.arange(count) * TENSOR_FRAMES
    stop = np.minimum(start + TENSOR_FRAMES, len(mel))
    batch = pa.record_batch(
        {
            "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(
                full.reshape(count, TENSOR_FRAMES, MELS)
            ),
            "start_s": start * step,
            "end_s": (stop - 1) * step + FRAME * DOWN / RATE,
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def audio_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, media``; ``media`` is a WAVE file.

    Its samples are the text's UTF-8 bytes and the padding. A null or empty text is padding alone.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    schema = fields(source, "doc_id", n_bytes="bigint", media="binary")

    def store(batch):
        data = [t.encode() for t in batch.column("text").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(d) for d in data],
            "media": [wav_of(payload_of(d)) for d in data],
        }

    return map_slices(source, store, schema, "text")


def audio_features(stored: DataFrame) -> DataFrame:
    """The columns of ``stored`` but ``media``, and what is read back from it.

    Adds ``payload_bytes, payload_sha256, tail_crc32`` (of the last 32 samples), ``log_mel`` (an
    Arrow stream of tensors, see ``read_tensors``), ``segments`` (spans of seconds) and
    ``feature``, a summary: frames that samples fill, segments, seconds in segments, mean of every
    fourth band. Frames cover every sample: the last value is held to the end of the last frame,
    which is in the tensors, segments and means, and whose span may end after the medium.
    Each medium is read by itself, so equal media give equal values, repeated rows equal rows and
    an empty table none; a null medium gives nulls. Memory follows the longest medium.
    """
    keep = [c for c in stored.columns if c != "media"]
    schema = fields(
        stored,
        *keep,
        payload_bytes="bigint",
        payload_sha256="string",
        tail_crc32="bigint",
        log_mel="binary",
        segments="array<struct<start_s:double,end_s:double>>",
        feature="string",
    )
    step, width = HOP * DOWN / RATE, FRAME * DOWN / RATE

    def features(media):
        if media is None:
            return [None] * 6
        _, payload = read_wav(media)
        x = np.frombuffer(payload, np.uint8).astype(np.float64) / 128 - 1
        mel = log_mel(resampled(whole_hops(x)))
        filled = max(1, (-(-len(x) // DOWN) - FRAME) // HOP + 1)
        spans = segments(mel)
        bands = np.round(mel.mean(axis=0, dtype=np.float64)[::4], 1)
        inside = sum(b - a for a, b in spans)
        summary = [filled, len(spans), f"{inside * step:.3f}", *(f"{v + 0:.1f}" for v in bands)]
        return [
            len(payload),
            sha256(payload).hexdigest(),
            zlib.crc32(payload[-32:]),
            tensors(mel),
            [{"start_s": a * step, "end_s": (b - 1) * step + width} for a, b in spans],
            ",".join(map(str, summary)),
        ]

    added = [f.name for f in schema][len(keep) :]

    def read(batch):
        rows = [features(m) for m in batch.column("media").to_pylist()]
        columns = {name: batch.column(name) for name in keep}
        return columns | dict(zip(added, map(list, zip(*rows))))

    return map_slices(stored, read, schema, "media")


@query("op6_audio_features")
def op6_audio_features(spark, sf_dir):
    stored = audio_media(table(spark, sf_dir, "documents"))
    stored = stored.withColumn("media_bytes", F.length("media").cast("long")).withColumn(
        "media_sha256", F.sha2("media", 256)
    )
    return audio_features(stored).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )
