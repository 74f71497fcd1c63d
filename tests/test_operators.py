"""Operators that SQL cannot express, against plain versions; sizes that tables do not reach; the command line."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import cli, dataset
from sonolith.functions import dsp, keys, meta, notes
from sonolith.functions import transforms as t
from sonolith.operators import beats, combine, events, fragment, pattern, registry, signal, splits
from sonolith.operators import notes as note_rows
from sonolith.sources import files
from tests.test_engine import write_wav


def plain_iir(x, b, a):
    y = []
    for n in range(len(x)):
        y.append((sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)) / a[0])
    return np.array(y)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 700])
def test_recursions_in_blocks(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in (dsp.biquad("peak", 44100, 900, 1, 6), dsp.pole_filter(100, 44100), dsp.butter_one("bandpass", 44100, (300, 700)), ((0.5,), (1.0, -0.9)), ((1.0, 0.5), (2.0,))):
        assert np.allclose(dsp.iir(x, b, a), plain_iir(x, b, a), atol=1e-9)


def test_all_pass_and_butterworth():
    h = dsp.iir(np.eye(1, 60_000)[0], *dsp.pole_filter(300, 44100))
    assert np.allclose(np.abs(np.fft.rfft(h)), 1, atol=1e-4)
    answer = lambda c, f: np.abs(np.polyval(c[0][::-1], np.exp(-2j * np.pi * f / 8000)) / np.polyval(c[1][::-1], np.exp(-2j * np.pi * f / 8000)))
    assert abs(answer(dsp.butter_one("lowpass", 8000, 500), 500) - 0.5**0.5) < 1e-9
    band = dsp.butter_one("bandpass", 8000, (400, 900))
    assert all(abs(answer(band, f) - 0.5**0.5) < 1e-9 for f in (400, 900))


@pytest.mark.parametrize(("up", "down"), [(3, 2), (2, 3), (147, 160), (1, 4), (5, 1)])
def test_resampling_against_direct_sums(up, down):
    x = np.random.default_rng(1).normal(size=90)
    half = 10 * max(up, down)
    k = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    k *= up / k.sum()
    want = [sum(x[i] * k[m * down - i * up + half] for i in range(90) if abs(m * down - i * up) <= half) for m in range(-(-90 * up // down))]
    assert np.allclose(dsp.resample(x, up, down), want)
    assert np.allclose(dsp.resample(np.stack([x, 2 * x]), up, down), [want, 2 * np.array(want)])


def test_compander_against_plain_steps():
    rng = np.random.default_rng(2)
    x = rng.normal(size=400) * 0.2
    for attack, release in ((0.1, 0.1), (0.01, 0.2)):
        up, down, volume, want = 1 - np.exp(-1 / (attack * 1000)), 1 - np.exp(-1 / (release * 1000)), 1.0, []
        for v in np.abs(x):
            volume += (v - volume) * (up if v > volume else down)
            want.append(volume)
        assert np.allclose(dsp.follow(np.abs(x), 1000, attack, release), want)
    points = [(-80.0, -80.0), (-40.0, -20.0), (0.0, 0.0)]
    level = np.linspace(-100, 6, 2000)
    out = dsp.transfer(level, points)
    far = (np.abs(level[:, None] - np.array([-80, -40, 0])) > 3).all(axis=1)
    assert np.allclose(out[far], np.interp(level, [-1080, -80, -40, 0, 1000], [-1080, -80, -20, 0, 1000])[far])
    assert np.abs(np.diff(out, 2)).max() < 0.01  # no corners
    assert np.abs(dsp.compress(x * 50, 1000, level_db=0.0)).max() <= 1


def test_slaney_bands_and_log_mel():
    assert np.allclose(dsp.slaney_hz(dsp.slaney_mel([10.0, 999.0, 1000.0, 5000.0])), [10, 999, 1000, 5000])
    assert abs(dsp.slaney_mel(6400.0) - 42) < 1e-9 and dsp.slaney_mel(200.0) == 3
    x = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)
    m = dsp.log_mel(x)
    assert m.shape == (128, 51)
    frame = np.pad(x, 512, mode="reflect")[10 * 441 : 10 * 441 + 1024] * np.hanning(1025)[:-1]
    bank = dsp.mel_bank(22050, 1024, 128, 30, 11000, "slaney")
    assert np.allclose(m[:, 10], np.log1p(1000 * bank @ np.abs(np.fft.rfft(frame)) / 32))


def test_pyin():
    sr = 22050
    time = np.arange(sr) / sr
    for hz in (110.0, 440.0, 880.0):
        f, voiced = dsp.pyin(np.sin(2 * np.pi * hz * time), sr)
        assert abs(np.median(f) - hz) < hz * 0.006 and voiced[3:-3].mean() > 0.9
    f, voiced = dsp.pyin(np.zeros(sr), sr)
    assert not f.any() and not voiced.any()


def test_vocoder():
    x = np.sin(2 * np.pi * 220 * np.arange(22050) / 22050)
    assert len(dsp.time_stretch(x, 1.5)) == 14700 and abs(np.median(dsp.yin(dsp.time_stretch(x, 1.5), 22050)) - 220) < 3
    up = dsp.pitch_shift(x, 12)
    assert len(up) == len(x) and abs(np.median(dsp.yin(up, 22050)) - 440) < 6


def test_ratios():
    ratios = dsp.stretch_ratios()
    assert ratios[0] == (7, 10) and all(0.7 <= a / b <= 1.3 and a != b and max(a, b) < 20 for a, b in ratios)
    assert dsp.nearest_ratio(ratios, 0.0) == ratios[0] and dsp.nearest_ratio(ratios, 9.0) == ratios[-1]


def test_transforms_are_linear_in_the_window(spark):
    """A window of full size, a few seconds in all; values against numpy."""
    n = 262_144
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i * 0.01) * 1.5).alias("x"))
    x = np.sin(np.arange(n) * 0.01) * 1.5
    got = df.select(t.gain(F.col("x"), F.lit(6.0)).alias("g"), t.normalise(F.col("x")).alias("n"), t.clip_share(F.col("x"), 0.1).alias("c"), t.delay(F.col("x"), F.lit(100.25), F.lit(0.5)).alias("d")).first()
    loud = x * 10**0.3
    assert np.allclose(got.g, loud / max(1, np.abs(loud).max())) and np.allclose(got.n, x / np.abs(x).max())
    k = int(0.05 * n)
    assert np.allclose(got.c, np.clip(x, np.sort(x)[k], np.sort(x)[n - k - 1]))
    wet = x[102:] + 0.5 * (1.75 * x[1:-101] - 0.75 * x[:-102])
    assert np.allclose(got.d, np.pad(wet, 51, mode="reflect"))


def test_keys_and_ranks(spark):
    got = [r.k for r in spark.createDataFrame([(7,), (10**9 - 1,), (10**9,), (1_000_000_002,)], "n long").select(keys.frag_key(F.col("n")).alias("k")).collect()]
    assert got == ["000000007", "999999999", "1000000000", "1000000002"]
    rows = [(f"k{i * 37 % 101}" if i % 9 else None, i % 3) for i in range(400)]
    for by in (None, "g"):
        ranked = keys.ordered_rank(spark.createDataFrame(rows, "k string, g int"), "k", "r", by).collect()
        for g in {r.g for r in ranked} if by else {None}:
            own = sorted((r for r in ranked if by is None or r.g == g), key=lambda r: r.r)
            assert [r.r for r in own] == list(range(len(own)))
            assert [r.k for r in own] == sorted((r.k for r in own), key=lambda v: (v is not None, v or ""))


def test_notes_and_bends():
    frames = np.zeros((120, 88))
    frames[20:60, 30] = 0.9
    frames[70:110, 50] = 0.6
    onsets = np.zeros((120, 88))
    onsets[20, 30] = 0.8
    assert notes.decode(frames, onsets, infer=False, melodia=False) == [(20, 60, 51, pytest.approx(0.9))]
    both = notes.decode(frames, onsets, infer=False)
    assert [n[2] for n in both] == [51, 71] and abs(both[1][0] - 70) <= 1 and abs(both[1][1] - 110) <= 1
    assert [n[2] for n in notes.decode(frames, onsets, infer=True, melodia=False)] == [51, 71]
    assert [n[2] for n in notes.decode(frames, onsets, high=300.0)] == [51]
    contours = np.zeros((120, 264))
    centre = int(np.round(notes.contour_bin(51)))
    for k in range(20, 60):
        contours[k, centre + (k - 20) // 20] = 1
    assert notes.bends(contours, [(20, 60, 51, 0.9)]) == [[0] * 20 + [1] * 20]
    times = notes.frame_times(400)
    assert times[0] == 0 and abs(times[1] - 256 / 22050) < 1e-12 and times[172] < 172 * 256 / 22050
    assert notes.decode(np.zeros((0, 88)), np.zeros((0, 88))) == []


def test_midi_files(spark, tmp_path):
    played = [(0.5, 1.0, 60, 0.5, [0, 1, -7]), (1.0, 2.0, 64, 1.0, None), (0.25, 2.5, 60, 0.25, None)]
    data = notes.build_midi(played)
    got = notes.parse_midi(data)
    assert [(n[2], n[3]) for n in got] == [(60, 32), (60, 64), (64, 127)]
    assert np.allclose([n[:2] for n in got][2], (1.0, 2.0), atol=2e-3) and got[0][0] == pytest.approx(0.25, abs=2e-3)
    tempo = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk\0\0\0\x1f\0\xff\x51\x03\x07\xa1\x20\0\x90\x3c\x40\x60\x3c\0\0\xff\x51\x03\x0f\x42\x40\0\x3e\x40\x60\x3e\0\0\xff\x2f\0"
    assert [(round(a, 6), round(b, 6), p) for a, b, p, _ in notes.parse_midi(tempo)] == [(0.0, 0.5, 60), (0.5, 1.5, 62)]
    frags = spark.createDataFrame([("r/a.wav", 0.0, 1.0), ("r/a.wav", 1.0, 1.0), ("r/b.wav", 0.0, 1.0), ("r/c.wav", 0.0, 1.0)], "file_path string, start_pos double, length double")
    midi = spark.createDataFrame([("r/a.wav", bytearray(data)), ("r/c.wav", bytearray(b"no midi"))], "file_path string, content binary")
    rows = {(r.file_path, r.start_pos): r.notes for r in note_rows.with_notes(frags, midi).collect()}
    assert [n.pitch for n in rows["r/a.wav", 0.0]] == [60, 60] and len(rows["r/a.wav", 1.0]) == 2 and rows["r/b.wav", 0.0] == rows["r/c.wav", 0.0] == []
    assert rows["r/a.wav", 1.0][0].start == 0.0 and rows["r/a.wav", 1.0][0].end == pytest.approx(1.0)
    table = spark.createDataFrame([(0.5, 1.0, 60, 0.5, [1, 2])], "start double, end double, pitch int, amplitude double, bends array<int>")
    note_rows.write_notes(table, str(tmp_path / "n"))
    written = spark.read.csv(str(tmp_path / "n"), header=True)
    assert written.columns == ["start_time_s", "end_time_s", "pitch_midi", "velocity", "pitch_bend"] and [tuple(r) for r in written.collect()] == [("0.5", "1.0", "60", "64", "1,2")]
    built = table.select(note_rows.midi_of(F.array(F.struct("*"))).alias("m")).first().m
    assert notes.parse_midi(bytes(built))[0][2:] == (60, 64)


def plain_minimal(beat, down, fps=50):
    def peaks(v):
        out, run = [], []
        for i, x in enumerate(v):
            if x > 0 and x == max(v[max(0, i - 3) : i + 4]):
                if run and i - run[0] <= 1:
                    run = [run[0] + (i - run[0]) / (run[1] + 1), run[1] + 1]
                else:
                    out += [run[0]] if run else []
                    run = [i, 1]
        return [p / fps for p in out + ([run[0]] if run else [])]

    b, d = peaks(beat), peaks(down)
    return b, sorted({min(b, key=lambda x: (abs(x - p), x)) for p in d} if b else set(d))


def test_minimal_post_processing(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for piece in range(6):
        beat, down = np.round(rng.normal(-1, 2, 200), 1), np.round(rng.normal(-2, 2, 200), 1)
        beat[50:53] = 9.0  # neighbours of one height
        rows += [(piece, k, float(b), float(d)) for k, (b, d) in enumerate(zip(beat, down))] + [(piece, 200 + k, None, None) for k in range(5)]
        want[piece] = plain_minimal(beat.tolist(), down.tolist())
    got = {}
    for r in beats.minimal(spark.createDataFrame(rows, "piece int, frame int, beat double, downbeat double"), "piece", "frame").collect():
        got.setdefault(r.piece, {"beat": [], "downbeat": []})[r.kind].append(r.time)
    for piece, (b, d) in want.items():
        assert np.allclose(sorted(got[piece]["beat"]), b) and np.allclose(sorted(got[piece]["downbeat"]), d)


@pytest.mark.parametrize("n", [0, 5, 30, 38, 39, 100, 137])
def test_chunks_and_stitching(spark, n):
    size, border = 50, 6
    starts = spark.createDataFrame([(n,)], "n int").select(beats.chunk_starts(F.col("n"), size, border).alias("s")).first().s
    want = list(range(-border, n - border, size - 2 * border)) if n else []
    if n > size - 2 * border:
        want[-1] = n - (size - border)
    assert starts == want
    if n:
        chunks = spark.createDataFrame([(1, s, [float(1000 * s + k) for k in range(size)]) for s in starts], "p int, s int, v array<double>")
        rows = {r.frame: r.v for r in beats.stitched(chunks, "p", "s", ["v"], size, border).collect()}
        for f in range(n):
            first = min(s for s in starts if s + border <= f < s + size - border)
            assert rows[f] == 1000 * first + f - first


def test_beat_clocks(spark):
    df = spark.createDataFrame([([0.5, 1.0, 1.5, 2.5], [0.5, 2.5], 0.0, 2.0, 5)], "b array<double>, d array<double>, s double, l double, n int")
    got = df.select(beats.clocks(F.col("b"), F.col("d"), F.col("s"), F.col("l"), F.col("n")).alias("c")).first().c
    assert np.allclose(got, [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]])  # at 0, 0.5, 1 ... a beat begins; two downbeats are too few
    assert np.allclose(beats.ramp([0.5, 1.0, 1.5], 2.0, 9), [0, 0.5, 0, 0.5, 0, 0.5, 0, 0, 0])
    tags = spark.createDataFrame([("song_ps3_ts-2.wav",), ("plain.wav",)], "f string").select(beats.augmentation(F.col("f")).alias("a")).collect()
    assert [tuple(r.a) for r in tags] == [(3, -2), (None, None)]
    assert spark.range(1).select(beats.frames_of(F.array(F.lit(1), F.lit(3)), F.lit(5)).alias("f")).first().f == [False, True, False, True, False]


def test_sampler_and_batches(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 5).alias("label"))
    got = combine.balanced_batches(rows, "label", "id", 4, 1).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch_id, []).append(r.id)
    assert all(len(v) == 4 for v in by.values()) and len({r.id for r in got}) == len(got)
    uneven = rows.where("label <> 0 or id < 30")
    rest = combine.balanced_batches(uneven, "label", "id", 3, 1, keep_rest=True)
    assert sorted(r.id for r in rest.collect()) == sorted(r.id for r in uneven.collect())
    assert sorted(r.id for r in combine.epoch(rows, "id").collect()) == list(range(100))
    assert combine.epoch(rows, "id", 7).count() == 7
    many = combine.epoch(rows, "id", 300, 2, replace=True)
    assert many.count() == 300 and many.select("draw").distinct().count() == 300
    sizes = [(f"l{i}", (i * 7) % 13 + 1) for i in range(50)]
    plan = dict(splits.balanced_plan(sorted(sizes, key=lambda s: (s[1], s[0])), {"a": 0.5, "b": 0.5}, sum(n for _, n in sizes)))
    placed = {p: sum(n for lab, n in sizes if plan[lab] == p) for p in ("a", "b")}
    assert all(abs(v - sum(placed.values()) / 2) < 0.15 * sum(placed.values()) for v in placed.values())


def test_merged_peaks_and_names(spark):
    rows = spark.createDataFrame([(u, float(v)) for u in range(3) for v in (1, 2, 2.5, 9, 10.5, 30)], "u int, x double")
    got = sorted(map(tuple, events.merge_close(rows, "u", "x", 1.5).collect()))
    assert got == [(u, k, pytest.approx(v)) for u in range(3) for k, v in enumerate([5.5 / 3, 9.75, 30])]
    names = spark.createDataFrame([("A4",), ("G♯-1",), ("Bb2",), ("X",), ("H1",)], "n string").select(events.pitch_of_name(F.col("n")).alias("c")).collect()
    assert [r.c for r in names] == [0, 11, 1, -1, None]
    m = spark.range(1).select(meta.written(meta.drop(meta.put(meta.only(a=1, b="x"), b="y", c=2.5), "a")).alias("m")).first().m
    assert json.loads(m) == {"b": "y", "c": "2.5"}


def test_random_udfs_depend_on_key_and_seed_alone(spark):
    df = spark.createDataFrame([(k, [float(np.sin(i * 0.3 + k)) for i in range(300)]) for k in range(6)], "k int, x array<double>")
    for make in (signal.phase_mangle(8000), signal.random_eq(8000), signal.random_distort(8000), signal.random_compress(8000), signal.random_mask(64, 16)):
        a = {r.k: r.y for r in df.select("k", make(F.col("x"), F.col("k"), 3).alias("y")).collect()}
        b = {r.k: r.y for r in df.repartition(5).select("k", make(F.col("x"), F.col("k"), 3).alias("y")).collect()}
        assert a == b and all(len(v) == 300 for v in a.values()) and np.isfinite(list(a.values())).all()
    burst = np.array(df.select(t.short_noises(F.col("x"), F.col("k"), 1, 100, 20).alias("y")).first().y) - np.array(df.first().x)
    assert all(0 < np.count_nonzero(burst[k : k + 100]) <= 20 for k in (0, 100, 200))
    far = dsp.air_absorption(np.random.default_rng(0).normal(size=4000), 44100, 50.0)
    assert np.abs(np.fft.rfft(far))[-400:].mean() < 0.6 * np.abs(np.fft.rfft(far))[:400].mean()


def test_outputs_by_position_and_name(spark):
    df = spark.createDataFrame([("k", [[1.0, 2.0]], [3.0])], "frag_key string, waveform array<array<double>>, f array<double>")
    double = lambda x: F.transform(x, lambda v: v * 2)
    of = lambda p, s: pattern.transformed(pattern.project(df, p), p, s).first()
    assert of("(waveform, f)", [None, double])._1 == [6.0] and of("{waveform->w, f}", {"w": double}).w == [[2.0, 4.0]] and of("f", [double, None]).f == [6.0]
    with pytest.raises(KeyError):
        of("{f}", {"g": double})
    with pytest.raises(TypeError):
        of("{f}", [double])
    q = spark.createDataFrame([([16384, -32767],)], "w array<smallint>")
    assert pattern.project(q, "w:audio").first().w == pytest.approx([16384 / 32767, -1]) and pattern.project(q, "w:array").first().w == [16384, -32767]
    assert json.loads(bytes(pattern.project(q, "w:buffer").first().w)) == {"value": [16384, -32767]}


def test_rates_parts_and_suffixes(spark, tmp_path):
    t8, t16 = (np.sin(np.arange(n) * 0.05) * 0.5 for n in (8000, 16000))
    write_wav(tmp_path / "r" / "a.wav", t8, 8000)
    write_wav(tmp_path / "r" / "b.wav", t16, 16000)
    built = dataset.preprocess(spark, [str(tmp_path / "r")], str(tmp_path / "o"), fragment.Windows(0.25, hop=0.25))
    sizes = {(r.sr, r.n, r.length) for r in built.rows.select("sr", F.size(F.element_at("waveform", 1)).alias("n"), "length").collect()}
    assert sizes == {(8000, 2000, 0.25), (16000, 4000, 0.25)} and len(built) == 8
    part = built.rows.select(F.size(files.partial(F.col("waveform"), F.col("sr"), 0.1, duration=0.1, channels=2)[1]).alias("n"), "sr").distinct().collect()
    assert {(r.sr, r.n) for r in part} == {(8000, 800), (16000, 1600)}
    full = spark.createDataFrame([("/x/r/a.wav",), ("/y/z/r/a.wav",), ("/x/ar/a.wav",)], "full_path string")
    assert files.by_suffix(spark.createDataFrame([("r/a.wav",)], "file_path string"), full).first().full_path == "/x/r/a.wav"


def test_folder_life(spark, tmp_path):
    root, out = tmp_path / "ds", str(tmp_path / "out")
    tone = np.sin(np.arange(8000) * 0.17) * 0.5
    for k in range(3):
        write_wav(root / f"T{k}" / "a.wav", tone)
    louder = registry.Feature("twice", lambda x: F.array_max(x) * 2, hash_from=lambda v: F.round(v, 0), pre_chunk=lambda audio: audio.withColumn("from_file", F.size(F.element_at("waveform", 1))))
    built = dataset.preprocess(spark, [str(root)], out, fragment.Windows(2000, hop=2000, sr=8000), sr=8000, features=[louder])
    assert built.query(twice=1.0).count() == 12 and built.rows.select("from_file").distinct().first()[0] == 8000
    assert "000000003" in built and "nope" not in built
    assert [r.frag_key for r in built.scan("000000002", "000000005").collect()] == ["000000002", "000000003", "000000004"]
    assert built.query(n=5, seed=1, original_path="ds/T1/a.wav").count() == 5
    held = lambda of: {p.name for part in of.snapshot["tables"]["fragments"]["parts"] for p in (tmp_path / "out" / part["path"]).glob("*.parquet")}
    before = held(built)
    write_wav(root / "T9" / "a.wav", tone)
    grown = dataset.update(spark, out, [str(root)])
    assert len(grown) == 16 and before < held(grown)
    assert grown.query(twice=1.0).count() == 16 and grown.rows.where("from_file = 8000").count() == 16
    assert grown.query(original_path="ds/T9/a.wav").count() == 4
    assert len(dataset.update(spark, out, [str(root)])) == 16
    small = dataset.compact(spark, out)
    assert len(small) == 16 and len(held(small)) == 1 and small.rows.columns == grown.rows.columns
    parts = small.split({"a": 0.5, "b": 0.5}, name="mine")
    assert small.has_split("mine") and not small.has_split("other")
    again = small.split({"a": 0.5, "b": 0.5}, name="mine", load_if_available=True, seed=99)
    assert sorted(r.frag_key for r in again["a"].rows.collect()) == sorted(r.frag_key for r in parts["a"].rows.collect())
    with pytest.raises(ValueError):
        parts["a"].split({"x": 1.0})
    named = dataset.update(spark, out, features={"partition": F.when(F.col("frag_key") < "000000004", "train").otherwise("val")})
    assert len(named.split({"train": 0.8, "val": 0.2})["train"]) == 4
    with pytest.raises(KeyError):
        named.split({"train": 0.5, "test": 0.5})
    lines = str(tmp_path / "t")
    splits.write_split_text(named.rows.withColumn("split", F.col("partition")), "frag_key", lines)
    assert splits.read_split_text(spark, lines).count() == 16


def test_command_line(spark, tmp_path):
    for k in range(2):
        write_wav(tmp_path / "ds" / f"T{k}" / "a.wav", np.sin(np.arange(8000) * 0.17) * 0.5)
    out = str(tmp_path / "out")

    def call(*words):
        text = io.StringIO()
        return cli.run(spark, cli.parser().parse_args(list(words)), text), text.getvalue()

    made, said = call("preprocess", "--path", str(tmp_path / "ds"), "--out", out, "--sample_rate", "8000", "--chunk_length", "2000", "--feature", "loudness", "--meta_regexp", "{{track}}/*.wav", "--check", "--compact", "--log", str(tmp_path / "log"))
    assert len(made) == 14 and said.startswith("2 files") and set(made.features) == {"loudness", "track"} and (tmp_path / "log").read_text() == "ds/T0/a.wav\t7\nds/T1/a.wav\t7\n"
    write_wav(tmp_path / "more" / "T5" / "a.wav", np.ones(8000) * 0.1)
    made, _ = call("update", "--path", out, "--data", str(tmp_path / "more"), "--feature", "pitch")
    assert len(made) == 21 and "pitch" in made.rows.columns
    (tmp_path / "m.json").write_text(json.dumps({"weights": [[0.1] * 16, [0.2] * 16], "stride": 16}))
    made, _ = call("add_embedding", "--path", out, "--module", str(tmp_path / "m.json"), "--transform", "reverse")
    assert made.rows.select(F.size("m").alias("n")).distinct().collect()[0].n == 2
    _, said = call("info", "--path", out, "--files", "--check_metadata", "--idx", "0", "--key", "000000001")
    assert "ds/T0/a.wav\t7" in said and "\tloudness" not in said and '"frag_key":"000000001"' in said
    with pytest.raises(KeyError):
        call("update", "--path", out, "--feature", "nope")


def plain_viterbi(observed, voiced, bins, reach, switch):
    states = [(v, b) for v in (0, 1) for b in range(bins)]
    with np.errstate(divide="ignore"):
        seen = np.log(np.array([[o[b] if v == 0 else (1 - p) / bins for v, b in states] for o, p in zip(observed, voiced)]))
    score, back = seen[0] - np.log(2 * bins), []
    for row in seen[1:]:
        step = lambda a, b: np.log((reach + 1 - abs(a[1] - b[1])) / (reach + 1) ** 2) + np.log(1 - switch if a[0] == b[0] else switch) if abs(a[1] - b[1]) <= reach else -np.inf
        every = np.array([[score[k] + step(a, b) for k, a in enumerate(states)] for b in states])
        back.append(every.argmax(axis=1))
        score = every.max(axis=1) + row
    return score.max(), seen


@pytest.mark.parametrize("reach", [1, 3, 10, 11, 12, 40])
def test_viterbi_against_all_steps(reach):
    rng = np.random.default_rng(reach)
    for share in (0.1, 0.5, 1.0):
        bins = 12
        observed = rng.random((5, bins)) / bins * (rng.random((5, bins)) < share)
        voiced = observed.sum(axis=1)
        best, ok = dsp._viterbi(observed, voiced, bins, reach, 0.1)
        most, seen = plain_viterbi(observed, voiced, bins, reach, 0.1)
        total = seen[0][best[0]] - np.log(2 * bins)
        for t in range(1, 5):
            (u, a), (v, b) = divmod(best[t - 1], bins), divmod(best[t], bins)
            assert ok and abs(a - b) <= reach
            total += np.log((reach + 1 - abs(a - b)) / (reach + 1) ** 2) + np.log(0.9 if u == v else 0.1) + seen[t][best[t]]
        assert abs(total - most) < 1e-9


def test_viterbi_needs_no_more_than_its_bins():
    """A reach beyond all bins costs no more than the bins do."""
    import tracemalloc

    observed = np.random.default_rng(0).random((3, 100)) / 200
    tracemalloc.start()
    dsp._viterbi(observed, observed.sum(axis=1), 100, 50_000, 0.01)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20
