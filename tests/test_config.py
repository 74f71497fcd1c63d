"""Layered configurations: includes, search paths, scopes, overrides, and what a dataset keeps of them."""

import json

import numpy as np
import pytest

from sonolith import cli, dataset
from sonolith.operators import config
from tests.test_engine import write_wav


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, value in files.items():
        (folder / f"{name}.json").write_text(json.dumps(value))


def test_layers(tmp_path):
    write(tmp_path / "lib", base={"windows": {"chunk": 100, "hop": 50}, "files": {"include": ["*.wav"]}}, loud={"audio": {"loudness_threshold": -60}})
    write(tmp_path, mine={"include": ["base", "loud"], "windows": {"hop": 25}, "files": {"include": ["a*"]}, "scopes": {"test": {"windows": {"pad": "zero"}}, "long": {"windows": {"chunk": 400}}}})
    path, lib = str(tmp_path / "mine"), [str(tmp_path / "lib")]
    assert config.resolve(path, lib) == {"windows": {"chunk": 100, "hop": 25}, "files": {"include": ["a*"]}, "audio": {"loudness_threshold": -60}}
    assert config.resolve(path, lib, ["long", "test"], ["windows.chunk=7", "files.parser=ranges"])["windows"] == {"chunk": 7, "hop": 25, "pad": "zero"}
    assert config.resolve("half_overlap_whole")["audio"] == {"loudness_threshold": -60.0}
    write(tmp_path, built={"include": ["half_overlap_padded", "mel"], "windows": {"hop": 7}})
    both = config.resolve(str(tmp_path / "built"))
    assert both["windows"]["chunk"] == 262144 and both["windows"]["hop"] == 7 and both["features"] == [{"entry": "mel"}]
    assert config.resolve(None, overrides=["windows.chunk=5"]) == {"windows": {"chunk": 5}}
    for wrong, error in ((lambda: config.resolve(path), FileNotFoundError), (lambda: config.resolve(path, lib, ["nope"]), KeyError), (lambda: config.resolve(path, lib, overrides=["windows.size=1"]), KeyError), (lambda: config.resolve(path, lib, overrides=["window.chunk=1"]), KeyError), (lambda: config.override("x"), ValueError)):
        with pytest.raises(error):
            wrong()
    write(tmp_path, a={"include": "b"}, b={"include": "a"})
    with pytest.raises(ValueError, match="includes"):
        config.resolve(str(tmp_path / "a"))


def test_dataset_keeps_what_it_was_built_with(spark, tmp_path):
    for k in range(2):
        write_wav(tmp_path / "ds" / f"T{k}" / "a.wav", np.sin(np.arange(4000) * 0.1) * 0.5)
    write(tmp_path / "lib", base={"windows": {"chunk": 500, "hop": 500}, "audio": {"sr": 8000}, "files": {"patterns": ["{{track}}/*.wav"]}})
    write(tmp_path, mine={"include": "base", "features": [{"entry": "loudness"}], "scopes": {"short": {"windows": {"chunk": 250}}}})
    args = ["preprocess", "--path", str(tmp_path / "ds"), "--out", str(tmp_path / "out"), "--config", str(tmp_path / "mine.json"), "--config_path", str(tmp_path / "lib"), "--scope", "short", "--override", "hop=1000", "--channels", "1"]
    made = cli.run(spark, cli.parser().parse_args(args))
    kept = made.metadata["config"]
    assert kept["windows"] == {"chunk": 250, "hop": 1000} and kept["audio"]["sr"] == 8000 and len(made) == 8
    again = dataset.preprocess(spark, [str(tmp_path / "ds")], str(tmp_path / "again"), **config.arguments(kept))
    assert again.rows.drop("root").exceptAll(made.rows.drop("root")).count() == 0 and again.metadata["windows"] == made.metadata["windows"] and again.metadata["features"] == ["track", "loudness"]
