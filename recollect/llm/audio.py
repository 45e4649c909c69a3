"""Media columns: audio features of clips stored as 8-bit PCM.

A clip is a RIFF/WAVE file. Its samples are resampled by a polyphase windowed-sinc filter (12 to 8 kHz), cut into
overlapped frames for log-mel filterbanks, and segmented by energy with hysteresis. Features leave as fixed-shape
tensors (blocks of 100 frames by 40 bands, the last one padded) in an Arrow stream, each block with its time span.
Each clip is worked on alone and in blocks, so equal clips give equal values and memory does not follow the length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, TARGET, UP, DOWN, TAPS = 12_000, 8_000, 2, 3, 24
WINDOW, HOP, BANDS, BLOCK = 256, 80, 40, 100
UNIT = 192
FLOOR = 1e-10


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file of the samples, byte for byte."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a mono 8-bit PCM file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _sinc() -> np.ndarray:
    """The low-pass filter at UP times the rate, a row of TAPS a phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    return (UP * cutoff * np.sinc(cutoff * n) * np.kaiser(UP * TAPS, 8.0)).reshape(TAPS, UP).T


PHASES = _sinc()


def resample(x: np.ndarray, block: int = 30_000) -> np.ndarray:
    """x at UP / DOWN times its rate; each output takes the taps of its own phase only."""
    n = -(-len(x) * UP // DOWN)
    y = np.zeros(n)
    padded = np.concatenate([np.zeros(TAPS - 1), x, np.zeros(DOWN)])
    for first in range(0, n, block * UP):
        for p in range(UP):
            m = np.arange(first + p, min(n, first + block * UP), UP)
            if len(m):
                at = m[0] * DOWN // UP
                windows = np.lib.stride_tricks.sliding_window_view(padded[at : at + (len(m) - 1) * DOWN + TAPS], TAPS)[::DOWN]
                y[m] = windows @ PHASES[m[0] * DOWN % UP][::-1]
    return y


def _mel() -> np.ndarray:
    """Triangular filters, even on the mel scale: WINDOW / 2 + 1 by BANDS."""
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + TARGET / 2 / 700), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, TARGET / 2, WINDOW // 2 + 1)[:, None]
    return np.maximum(0, np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])))


MEL, HANN = _mel(), np.hanning(WINDOW)


def log_mel(y: np.ndarray, block: int = 4096) -> np.ndarray:
    """Natural log energies, frames by BANDS; frames overlap and cover every sample, at least one of them."""
    frames = 1 + -(-max(0, len(y) - WINDOW) // HOP)
    y = np.concatenate([y, np.zeros((frames - 1) * HOP + WINDOW - len(y))])
    out = np.empty((frames, BANDS), np.float32)
    for a in range(0, frames, block):
        part = np.lib.stride_tricks.sliding_window_view(y[a * HOP : (min(frames, a + block) - 1) * HOP + WINDOW], WINDOW)[::HOP]
        spectrum = np.fft.rfft(part * HANN, axis=1)
        out[a : a + block] = np.log((spectrum.real**2 + spectrum.imag**2) @ MEL + FLOOR)
    return out


def segments(mel: np.ndarray, enter: float = 0.35, leave: float = 0.1) -> list[tuple[int, int]]:
    """Spans (start, end in frames, end exclusive): a span begins at `enter` above the clip's median energy and lasts
    until the energy falls below `leave` above it."""
    energy = np.log(np.exp(mel.astype(np.float64)).sum(1))
    level = energy - np.median(energy)
    event = np.where(level >= enter, 1, np.where(level < leave, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[last] == 1)
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: tensor (BLOCK, BANDS) float32, frames in use, start_ms, end_ms of each block."""
    blocks = -(-len(mel) // BLOCK)
    full = np.full((blocks, BLOCK, BANDS), np.float32(np.log(FLOOR)))
    full.reshape(-1, BANDS)[: len(mel)] = mel
    used = [min(BLOCK, len(mel) - BLOCK * i) for i in range(blocks)]
    ms = 1000 * HOP // TARGET
    columns = [pa.FixedShapeTensorArray.from_numpy_ndarray(full), pa.array(used, pa.int32()), pa.array([BLOCK * i * ms for i in range(blocks)], pa.int64()), pa.array([(BLOCK * i + n - 1) * ms + 1000 * WINDOW // TARGET for i, n in enumerate(used)], pa.int64())]
    batch = pa.record_batch(columns, names=["tensor", "frames", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stream: bytes) -> np.ndarray:
    """The frames in use of all blocks, by BANDS."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    full = batch.column("tensor").to_numpy_ndarray()
    return np.concatenate([block[:n] for block, n in zip(full, batch.column("frames").to_pylist(), strict=True)])


def describe(mel: np.ndarray) -> str:
    """Frames and bands; rounded mean of each band in hundredths; energy segments in ms."""
    ms = 1000 * HOP // TARGET
    means = np.rint(100 * mel.astype(np.float64).mean(0)).astype(int)
    return f"{len(mel)}x{BANDS};{','.join(map(str, means))};{','.join(f'{a * ms}-{b * ms}' for a, b in segments(mel))}"


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the bytes with blanks up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


#: Output columns of clips(); media and tensors are made for every row, but are large and come only if asked for.
COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "tensors": pa.binary()}
SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
DIGEST = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def clip(text: str | None, want: tuple[str, ...]) -> dict:
    n, raw = payload(text)
    media = to_wav(raw)
    _, back = from_wav(media)
    stream = tensors(log_mel(resample((np.frombuffer(back, np.uint8) - 128.0) / 128.0)))
    got = {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": describe(from_tensors(stream))}
    if "media" in want:
        got["media"] = media
    if "tensors" in want:
        got["tensors"] = stream
    return got


def clips(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", want: tuple[str, ...] = (*DIGEST, "media", "tensors"), rows_a_batch: int = 64) -> DataFrame:
    """id and the wanted COLUMNS of every row: the text's bytes as a clip, read back, and its features, which are taken
    from the tensors read back.

    Null and empty texts are one UNIT of blanks, n_bytes 0. Repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows_a_batch):
                part = b.slice(at, rows_a_batch)
                got = [clip(t, want) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[c] for g in got], COLUMNS[c]) for c in want)], ["id", *want])

    schema = ", ".join(["id long", *(f"{c} {SQL[COLUMNS[c]]}" for c in want)])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
