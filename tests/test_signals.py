"""Range reads of PCM files: formats, shares of windows, long files, pushed-down starts, files that cannot be read."""

import dataclasses
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import dataset
from sonolith.operators.fragment import Windows
from sonolith.sources import files, signals


def wav(x, sr, width, channels=1, tag=1, extensible=False, floats=False):
    if floats:
        raw = x.T.astype(f"<f{width}").tobytes()
    elif width == 1:
        raw = (x.T * 127 + 128).astype(np.uint8).tobytes()
    elif width == 3:
        raw = np.frombuffer((x.T * 8388607).astype("<i4").tobytes(), np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raw = (x.T * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes()
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, sr, sr * channels * width, channels * width, 8 * width)
    if extensible:
        form += struct.pack("<HHIH14s", 22, 8 * width, 0, tag, b"\0" * 14)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff(x, sr, width, kind=None, floats=False):
    raw = x.T.astype(f">f{width}").tobytes() if floats else (x.T * (2 ** (8 * width - 1) - 1)).astype(("<" if kind == b"sowt" else ">") + f"i{width}").tobytes()
    exponent = sr.bit_length() - 1
    rate = struct.pack(">HQ", 16383 + exponent, sr << (63 - exponent))
    comm = struct.pack(">hIh", len(x), x.shape[1], 8 * width) + rate + ((kind + b"\0\0") if kind else b"")
    body = (b"AIFC" if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(raw) + 8) + b"\0" * 8 + raw
    return b"FORM" + struct.pack(">I", len(body)) + body


X = np.stack([np.sin(np.arange(900) * 0.05), np.cos(np.arange(900) * 0.03)]) * 0.9


@pytest.mark.parametrize(
    ("data", "error"),
    [(wav(X, 8000, w, 2), 2.0 ** (2 - 8 * w)) for w in (1, 2, 3, 4)]
    + [(wav(X, 8000, 2, 2, extensible=True), 1e-4), (wav(X, 8000, 4, 2, 3, floats=True), 1e-7), (wav(X, 8000, 8, 2, 3, floats=True), 1e-12)]
    + [(aiff(X, 8000, w), 2.0 ** (2 - 8 * w)) for w in (1, 2, 4)]
    + [(aiff(X, 8000, 2, b"sowt"), 1e-4), (aiff(X, 8000, 4, b"fl32", floats=True), 1e-7), (aiff(X, 8000, 2, b"NONE"), 1e-4)],
)
def test_formats(data, error):
    sr, x = signals.decoded(data)
    assert sr == 8000 and x.shape == X.shape and np.abs(x - X).max() < error


@pytest.mark.parametrize("data", [b"", b"RIFF", b"no audio at all", wav(X, 8000, 2, 2)[:30], wav(X, 8000, 2, 2, tag=85), wav(X, 0, 2, 2), aiff(X, 8000, 2, b"ima4"), aiff(X, 8000, 2)[:20]])
def test_files_that_cannot_be_read(data):
    with pytest.raises(signals.Unreadable):
        signals.decoded(data)


def test_a_cut_file_gives_what_is_there():
    assert signals.decoded(wav(X, 8000, 2, 2)[:-400])[1].shape == (2, 800)


@pytest.mark.parametrize("cutting", [Windows(64, hop=64), Windows(64, hop=17, pad="zero", least=5), Windows(0.01, hop=0.02), Windows(100, hop=300), Windows(2000, hop=10, pad="repeat")])
def test_shares_of_windows_make_up_the_whole(tmp_path, monkeypatch, cutting):
    (tmp_path / "a.wav").write_bytes(wav(X, 8000, 2, 2))
    monkeypatch.setattr(signals, "HELD", 1000)
    x = signals.decoded((tmp_path / "a.wav").read_bytes())[1].astype(np.float32)
    chunk, hop, least = cutting.samples(8000)
    want = [(k, x[:, k : k + chunk].tolist()) for k in range(0, 900, hop) if 900 - k >= least]
    for parts in (1, 2, 7, 50):
        got = [(r["start"], r["waveform"]) for p in range(parts) for b in signals.cut(str(tmp_path / "a.wav"), "a", cutting, p, parts) for r in b.to_pylist()]
        assert got == want
    some = [r["start"] for b in signals.cut(str(tmp_path / "a.wav"), "a", cutting, low=50, high=400) for r in b.to_pylist()]
    assert some == [k for k, _ in want if 50 <= k < 400]


def test_long_file_is_many_tasks_work(spark, tmp_path):
    root = tmp_path / "ds"
    root.mkdir()
    n = 6_000_000
    with wave.open(str(root / "long.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.arange(n) % 30011).astype("<i2").tobytes())
    (root / "bad.wav").write_bytes(b"nothing")
    (root / "other.mp3").write_bytes(b"ID3")
    cutting = Windows(8000, hop=8000)
    scanned = files.scan(spark, [str(root)], content=False)
    found = signals.windows(scanned, cutting, split=1 << 20).withColumn("task", F.spark_partition_id())
    rows = found.select("file_path", "start", "task", "problem", F.element_at(F.element_at("waveform", 1), 1).alias("first"), F.size(F.element_at("waveform", 1)).alias("n")).collect()
    long = sorted((r.start, round(r.first * 32768), r.n) for r in rows if r.start is not None)
    assert long == [(k, k % 30011, 8000) for k in range(0, n, 8000)]
    assert len({r.task for r in rows if r.start is not None}) > 4
    assert {r.file_path: r.problem for r in rows if r.problem} == {"ds/bad.wav": "neither wave nor AIFF", "ds/other.mp3": "neither wave nor AIFF"}
    ours = signals.source(spark, str(root), cutting, split_bytes=1 << 20)
    assert sorted(r.start for r in ours.where("start >= 16000 and start < 40000").select("start").collect()) == [16000, 24000, 32000]
    assert ours.where("file_path = 'ds/bad.wav'").count() == 1 and ours.where("start is not null").count() == 750
    reader = signals._Reader({"path": str(root), "windows": json.dumps(dataclasses.asdict(cutting)), "split_bytes": 1 << 20})
    assert len([p for p in reader.partitions() if p.name == "ds/long.wav"]) == 12


def test_datasets_by_ranges_equal_those_of_whole_files(spark, tmp_path):
    for k in range(3):
        path = tmp_path / "ds" / f"T{k}"
        path.mkdir(parents=True)
        (path / "a.wav").write_bytes(wav(X * (k + 1) / 3, 8000, 2, 2))
        (path / "b.aif").write_bytes(aiff(X * (k + 1) / 4, 8000, 2))
    (tmp_path / "ds" / "bad.flac").write_bytes(b"fLaC")
    made = {}
    for parser in ("files", "ranges"):
        out = str(tmp_path / parser)
        dataset.preprocess(spark, [str(tmp_path / "ds")], out, Windows(100, hop=50, pad="zero", least=10), channels=1, patterns=["{{track}}/*"], features={"peak": "array_max(element_at(waveform, 1))"}, exclude=["*T2*"], dir_parser=parser)
        made[parser] = dataset.update(spark, out, [str(tmp_path / "ds")], exclude=["*T1*"])
        told = {r.file_path: r.problem for r in dataset.info(made[parser])["skipped"].collect()}
        assert told == {"ds/bad.flac": "neither wave nor AIFF"} and made[parser].metadata["n_skipped"] == 1
    rows = [sorted(map(repr, made[p].rows.select("file_path", "start_pos", "length", "file_length", "sr", "waveform", "track", "peak").collect())) for p in made]
    assert rows[0] == rows[1] and len(rows[0]) == 6 * 18
    with pytest.raises(ValueError, match="hooks"):
        from sonolith.operators import registry

        dataset.preprocess(spark, [str(tmp_path / "ds")], str(tmp_path / "x"), Windows(100), features=[registry.Feature("a", F.array_max, pre_chunk=lambda d: d)], dir_parser="ranges")


def test_small_files_share_tasks(spark, tmp_path):
    root = tmp_path / "ds"
    root.mkdir()
    for k in range(200):
        (root / f"{k}.wav").write_bytes(wav(X[:, : 100 + k], 8000, 2, 2))
    (root / "bad.wav").write_bytes(b"nothing")
    cutting = Windows(64, hop=32)
    reader = signals._Reader({"path": str(root), "windows": json.dumps(dataclasses.asdict(cutting)), "split_bytes": 700})
    tasks = reader.partitions()
    held = [(r.name, r.part) for t in tasks for r in t.ranges]
    assert len(tasks) == -(-len(held) // signals.SHARED) and len(held) == len(set(held)) > 300
    want = sorted((f"ds/{k}.wav", start) for k in range(200) for start in range(0, 100 + k - 63, 32))
    ours = signals.source(spark, str(root), cutting, split_bytes=700).where("start is not null")
    assert sorted(map(tuple, ours.select("file_path", "start").collect())) == want
    found = signals.windows(files.scan(spark, [str(root)], content=False), cutting, split=700)
    assert found.rdd.getNumPartitions() <= len(tasks)
    assert sorted(map(tuple, found.where("start is not null").select("file_path", "start").collect())) == want
    assert [r.problem for r in found.where("problem is not null").collect()] == ["neither wave nor AIFF"]
