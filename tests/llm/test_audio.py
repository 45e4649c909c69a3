import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from recollect.llm import audio as A


def test_wav_round_trip():
    raw = bytes(range(256)) * 3
    media = A.to_wav(raw)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getframerate(), w.getsampwidth(), w.readframes(10**6)) == (A.RATE, 1, raw)
    assert A.from_wav(media) == (A.RATE, raw) and A.from_wav(A.to_wav(b"abc"))[1] == b"abc"


def test_resample_is_filter_then_pick():
    x = np.random.default_rng(0).standard_normal(1000)
    up = np.zeros(len(x) * A.UP)
    up[:: A.UP] = x
    h = A.PHASES.T.reshape(-1)
    full = np.convolve(up, h)[: len(up)][:: A.DOWN]
    assert np.allclose(A.resample(x), full[: len(A.resample(x))]) and np.allclose(A.resample(x, 7), A.resample(x))
    tone = np.sin(2 * np.pi * 500 * np.arange(12000) / A.RATE)
    y = A.resample(tone)
    assert abs(np.abs(np.fft.rfft(y)).argmax() * A.TARGET / len(y) - 500) < 2 and abs(y[1000:-1000].std() - tone.std()) < 0.02


def test_mel_and_segments():
    y = np.zeros(8000)
    y[3000:5000] = np.sin(2 * np.pi * 1000 * np.arange(2000) / A.TARGET)
    mel = A.log_mel(y)
    direct = np.log(np.abs(np.fft.rfft(y[4000:4256] * A.HANN)) ** 2 @ A.MEL + A.FLOOR)
    assert np.allclose(mel[50], direct, atol=1e-4) and np.allclose(A.log_mel(y, 7), mel)
    (a, b), = A.segments(mel)
    assert 33 <= a <= 38 and 61 <= b <= 64
    assert A.segments(np.zeros((5, 40), np.float32)) == []


def test_hysteresis():
    mel = np.log(np.array([1, 2, 1.2, 1, 1.2, 1, 1])[:, None] / 40 * np.ones((1, 40))).astype(np.float32)
    assert A.segments(mel) == [(1, 3)]


def test_clips(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (3, "é" * 96, b"x"), (4, "long text " * 30000, b"x"), (4, "long text " * 30000, b"x"), (5, "a", b"x")]
    got = A.clips(spark.createDataFrame(rows, "doc_id long, text string, media binary")).collect()
    assert len(got) == len(rows)
    for x in got:
        text = next(t for d, t, _ in rows if d == x.doc_id) or ""
        raw = text.encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert A.from_wav(bytes(x.media))[1] == padded and x.media_sha256 == hashlib.sha256(bytes(x.media)).hexdigest() and x.media_bytes == len(x.media)
        t = pa.ipc.open_stream(bytes(x.tensors)).read_all()
        assert t.column("tensor").type.shape == [100, 40] and sum(t.column("frames").to_pylist()) == int(x.feature.split("x")[0]) and t.column("start_ms").to_pylist()[0] == 0
    assert len({x.feature for x in got if x.doc_id == 4}) == 1 and got[0].feature == got[1].feature
    assert A.clips(spark.createDataFrame([], "doc_id long, text string")).collect() == []
