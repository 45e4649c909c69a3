"""The query's columns come from the stored tensors."""

import numpy as np

from recollect.llm import audio


def test_feature_is_read_from_tensors(monkeypatch):
    text = "some text of a clip " * 700
    plain = audio.clip(text, audio.DIGEST)
    build, seen = audio.tensors, []

    def louder(mel):
        seen.append(len(mel))
        return build(mel + np.float32(1))

    monkeypatch.setattr(audio, "tensors", louder)
    shifted = audio.clip(text, audio.DIGEST)
    assert len(seen) == 1 and seen[0] > audio.BLOCK
    means = [np.array(c["feature"].split(";")[1].split(","), int) for c in (plain, shifted)]
    assert np.abs(means[1] - means[0] - 100).max() <= 1


def test_round_trip():
    for frames in (1, 99, 100, 101, 250):
        mel = np.random.default_rng(frames).normal(size=(frames, audio.BANDS)).astype(np.float32)
        assert np.array_equal(audio.from_tensors(audio.tensors(mel)), mel)
