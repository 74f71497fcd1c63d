"""The loudness filter on several channels."""

import wave

import numpy as np


def test_loudness_filter_hears_all_channels(spark, tmp_path):
    from sonolith import dataset
    from sonolith.operators.fragment import Windows

    tone = (0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000) * 32767).astype("<i2")
    root = tmp_path / "in"
    root.mkdir()
    for name, channels in (("loud", [tone * 0, tone]), ("silent", [tone * 0, tone * 0])):
        with wave.open(str(root / f"{name}.wav"), "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(2)
            f.setframerate(8000)
            f.writeframes(np.stack(channels, 1).tobytes())
    built = dataset.preprocess(spark, [str(root)], str(tmp_path / "out"), Windows(1.0, sr=8000), sr=8000, channels=2, loudness_threshold=-60.0)
    assert [r.file_path.rsplit("/")[-1] for r in built.rows.collect()] == ["loud.wav"]
