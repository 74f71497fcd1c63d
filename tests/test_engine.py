"""Kernels, parsers, splits and the dataset folder: properties and small examples."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import dataset
from sonolith.functions import arrays, dsp, globs, keys, notes
from sonolith.operators import combine, events, fragment, index, pattern, signal, splits
from sonolith.sources import files
from sonolith.streaming import ingest


def one(spark, values, column, kind="array<double>"):
    return spark.createDataFrame([(values,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
@pytest.mark.parametrize("mode", ["zero", "repeat", "replicate", "reflect"])
def test_padding(spark, n, mode):
    x = [float(k + 1) for k in range(n)]
    got = one(spark, x, arrays.pad(F.col("x"), 20, mode))
    want = list(x)
    while len(want) < 20:
        m = min(20 - len(want), len(want) - 1) if n > 1 else 20 - len(want)
        if mode == "zero":
            want += [0.0] * (20 - len(want))
        elif mode == "replicate" or n == 1:
            want += [want[-1]] * (20 - len(want))
        elif mode == "repeat":
            want += want[:m]
        else:
            want += want[-1 - m : -1][::-1]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 17])
@pytest.mark.parametrize("pad", arrays.PAD_MODES)
def test_window_counts(spark, n, pad):
    df = spark.createDataFrame([(1, [float(k) for k in range(n)])], "id int, waveform array<double>")
    rows = fragment.fragments(df, fragment.Windows(8, hop=4, pad=pad)).collect()
    assert len(rows) == (max(0, (n - 8) // 4 + 1) if pad == "discard" else math.ceil(n / 4))
    assert all(len(r.waveform) == 8 for r in rows)


def test_window_options():
    assert fragment.Windows(1.0, hop=0.5).samples() == (44100, 22050, 44100)
    assert fragment.PRESETS["half_overlap_padded"].samples() == (262144, 131072, 32000)
    for bad in (dict(hop=2, overlap=0.5), dict(overlap=1.0), dict(pad="none"), dict(hop=0)):
        with pytest.raises(ValueError):
            fragment.Windows(8, **bad).samples()


def test_quantise_clamps(spark):
    assert one(spark, [1.5, -2.0, 0.5, -0.00001], arrays.quantise(F.col("x"))) == [32767, -32767, 16383, 0]
    assert one(spark, [1.0, 2.0, 3.0], arrays.centred(F.col("x"), 6, "zero")) == [0.0, 1.0, 2.0, 3.0, 0.0, 0.0]
    assert one(spark, [1.0, 2.0, 3.0], arrays.centred(F.col("x"), 6)) == [2.0, 1.0, 2.0, 3.0, 2.0, 1.0]
    assert one(spark, [1.0, 2.0], arrays.centred(F.col("x"), 7)) == [0.0, 2.0, 1.0, 2.0, 1.0, 0.0, 0.0]
    assert one(spark, [1.0, 2.0, 3.0, 4.0], arrays.centred(F.col("x"), 3)) == [1.0, 2.0, 3.0]


def test_file_globs(spark):
    paths = ["ds/a.wav", "ds/short/b.opus", "ds/long/x/c.flac", "ds/d.Wav", "ds/e.WAV"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    hits = lambda c: [r.p for r in df.where(c).collect()]
    assert hits(globs.has_extension(F.col("p"))) == [paths[k] for k in (0, 1, 2, 4)]
    assert hits(globs.any_of(F.col("p"), ["*/long/*", "*.wav"])) == [paths[0], paths[2]]
    assert hits(globs.none_of(F.col("p"), ["*.opus", "*.[wW]*"])) == [paths[2]]


def test_feature_patterns(spark):
    df = spark.createDataFrame([("ds/Track01/stems/S07.flac",), ("ds/other.wav",)], "p string")
    ps = ["{{track}}/stems/{{stem}}.flac"]
    assert set(globs.fields(ps)) == {"track", "stem"}
    got = df.select(globs.captured(F.col("p"), ps, "track").alias("t"), globs.captured(F.col("p"), ps, "stem").alias("s")).collect()
    assert [tuple(r) for r in got] == [("Track01", "S07"), (None, None)]


@pytest.mark.parametrize(("text", "shape", "n"), [("waveform", "scalar", 1), ("(waveform,)", "tuple", 1), ("waveform,", "tuple", 1), ("(waveform[0],)", "tuple", 1), ("(waveform[0:1:1],)", "tuple", 1), ("{waveform,}", "dict", 1), ("{ waveform[:1] -> z, b:array }", "dict", 2)])
def test_patterns(text, shape, n):
    found, items = pattern.parse(text)
    assert (found, len(items)) == (shape, n)


@pytest.mark.parametrize("text", ["{a->b->c}", "(a->b)", "{a", "(a", "a[1:2:0]", "a:odd", ""])
def test_bad_patterns(text):
    with pytest.raises(ValueError):
        pattern.parse(text)


def test_loudness():
    sr = 8000
    t = np.arange(sr * 2) / sr
    tone = np.sin(2 * np.pi * 997 * t)
    assert dsp.loudness(np.zeros(sr), sr) == dsp.SILENT
    full, half = dsp.loudness(tone, sr), dsp.loudness(tone / 2, sr)
    assert abs(full - half - 6.02) < 0.4 and -5 < full < 2
    assert dsp.loudness(np.stack([tone, tone]), sr) > full + 2.9


def test_kernels():
    sr = 22050
    t = np.arange(sr) / sr
    for hz in (110.0, 220.0, 440.0, 880.0):
        f = dsp.yin(np.sin(2 * np.pi * hz * t), sr)
        assert abs(np.median(f) - hz) < hz * 0.01
    assert len(dsp.resample(np.ones(100), 3, 2)) == 150
    low = dsp.iir(np.sin(2 * np.pi * 5000 * t), *dsp.biquad("lowpass", sr, 200))
    assert np.abs(low[1000:]).max() < 0.01
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(dsp.mask_frequencies(x, 10, 0)[100:-100], x[100:-100], atol=1e-6)
    assert dsp.mel(x, sr).shape[0] == 128 and dsp.cqt(x[:2000], sr, n_bins=4, fmin=500).shape[:2] == (2, 4)
    assert np.abs(dsp.compress(x, sr)).max() <= 1
    a = np.zeros((60, 88))
    a[10:40, 1] = 0.9
    o = np.zeros((60, 88))
    o[10, 1] = 0.8
    assert notes.decode(a, o) == [(10, 40, 22, pytest.approx(0.9))]


def test_pitch_classes(spark):
    df = spark.createDataFrame([(440 * 2 ** (k / 12),) for k in range(12)] + [(0.0,)], "hz double")
    got = [r.c for r in df.select(events.pitch_class(F.col("hz")).alias("c")).collect()]
    assert got == [*range(12), -1]


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 37).alias("label"))
    parts = splits.split_rows(rows, "id", {"a": 0.7, "b": 0.25}, 1)
    assert {r.split: r.n_rows for r in splits.split_report(parts).collect()} == {"a": 700, "b": 250, None: 50}
    by = splits.split_labels(rows, ["label"], {"a": 0.5, "b": 0.5}, 1).groupBy("label").agg(F.count_distinct("split").alias("n"))
    assert by.where("n > 1").count() == 0
    assert dict(splits.balanced_plan([("p", 1), ("q", 1), ("r", 2), ("s", 5), ("t", 8)], {"a": 0.5, "b": 0.3, "c": 0.2}, 17)) == {"p": "a", "q": "c", "r": "b", "s": "a", "t": None}
    with pytest.raises(ValueError):
        splits.split_rows(rows, "id", {"a": 1.2})


def test_split_store(spark, tmp_path):
    rows = spark.range(50).select(keys.frag_key(F.col("id")).alias("k"))
    splits.write_splits(splits.split_rows(rows, "k", {"train": 0.8, "val": 0.2}), "k", str(tmp_path / "s"))
    assert splits.read_splits(spark, str(tmp_path / "s")).groupBy("split").count().collect().__len__() == 2
    (tmp_path / "p.txt").write_text("train;000000001,000000002\nval;000000003\n")
    assert splits.read_split_text(spark, str(tmp_path / "p.txt")).count() == 3


def test_index_errors(spark):
    rows = spark.createDataFrame([("k1", "a"), ("k2", None)], "k string, f string")
    idx = index.feature_index(rows, {"f": F.col("f")}, "k")
    with pytest.raises(KeyError):
        index.require_values(idx, {"f": ["zz"]})
    with pytest.raises(KeyError):
        index.required(rows, ["nope"])


def test_concatenation_checks_schemas(spark):
    with pytest.raises(ValueError):
        combine.concatenate([spark.range(3), spark.range(3).withColumnRenamed("id", "x")])


def test_transform_udfs(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").select(F.col("embedding").alias("x")).limit(5)
    got = rows.select(F.size(signal.filtered("highpass", 64, 4)(F.col("x"))).alias("a"), F.size(signal.add_coloured_noise(1, 0.1)(F.col("x"))).alias("b")).collect()
    assert all(tuple(r) == (64, 64) for r in got)
    with pytest.raises(NotImplementedError):
        signal.unavailable("crepe")


def write_wav(path, x, sr=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())


def test_dataset_folder(spark, tmp_path):
    t = np.arange(8000) / 8000
    root = tmp_path / "ds"
    for k in range(4):
        write_wav(root / f"Track{k:02}" / "a.wav", np.sin(2 * np.pi * 200 * (k + 1) * t) * 0.5)
    write_wav(root / "Track09" / "skip.wav", t)
    (root / "Track00" / "broken.wav").write_bytes(b"no audio")
    out = str(tmp_path / "out")
    w = fragment.Windows(2000, hop=1000, sr=8000)
    built = dataset.preprocess(spark, [str(root)], out, w, sr=8000, channels=2, exclude=["*skip*"], patterns=["{{track}}/*.wav"], loudness_threshold=-60.0)
    assert len(built) == 4 * 7
    assert built.metadata["n_chunks"] == 28 and built.metadata["features"] == ["track"]
    assert built.query(track=["Track01", "Track02"]).count() == 14
    assert built.query(n=3, original_path="ds/Track03/a.wav").count() == 3
    assert built.get("000000000", "{waveform[0]->w, track}").columns == ["frag_key", "w", "track"]
    assert built.at(27).count() == 1 and built.at(28).count() == 0
    parts = built.split({"train": 0.5, "test": 0.5}, ["track"], balance=True, name="s")
    assert len(parts["train"]) + len(parts["test"]) == 28
    assert len(built.load_split("s")["train"]) == len(parts["train"])
    with pytest.raises(Exception):
        dataset.preprocess(spark, [str(root)], out, w, sr=8000)
    write_wav(root / "Track08" / "a.wav", np.sin(2 * np.pi * 300 * t))
    grown = dataset.update(spark, out, [str(root)], {"size": F.lit(1)})
    assert len(grown) == 35 and grown.rows.select("frag_key").distinct().count() == 35
    with_views = dataset.add_embedding(spark, out, "emb", signal.embedding(17, 3, 16), [lambda x: F.transform(x, lambda v: -v)])
    assert with_views.rows.select(F.size("emb").alias("n")).distinct().collect()[0].n == 2
    assert dataset.info(with_views)["files"].count() == 5


def test_side_files_and_stream(spark, tmp_path):
    audio = spark.createDataFrame([("r/T1/stems/S1.wav",), ("r/T2/x.wav",)], "file_path string")
    midi = spark.createDataFrame([("r/T1/MIDI/S1.mid",), ("r/T1/midi/S1.mid",), ("r/T2/x.mid",)], "file_path string")
    assert {r.file_path: r.midi_path for r in files.side_files(audio, midi).collect()} == {"r/T1/stems/S1.wav": "r/T1/midi/S1.mid", "r/T2/x.wav": "r/T2/x.mid"}
    root = tmp_path / "in"
    write_wav(root / "a.wav", np.zeros(100))
    cut = lambda rows: rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_path"), "length")
    for name in ("a.wav", "b.wav"):
        write_wav(root / name, np.zeros(100))
        ingest.ingest(ingest.audio_stream(spark, str(root)), cut, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
