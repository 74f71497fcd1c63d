"""Beat metrics against plain loops, beat by beat; framing and stacking against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import spectra
from sonolith.operators import beat_metrics as bm
from sonolith.operators import fragment


def pairs(a, b, window):
    """The most pairs, by augmenting paths."""
    mate = {}

    def place(i, seen):
        for j, t in enumerate(b):
            if abs(a[i] - t) <= window and j not in seen:
                seen.add(j)
                if j not in mate or place(mate[j], seen):
                    mate[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def tapped(truth):
    double = [x for i, t in enumerate(truth) for x in ([t, (t + truth[i + 1]) / 2] if i + 1 < len(truth) else [t])]
    return [truth, double[1::2], double, truth[::2], truth[1::2]]


def continuity(truth, found):
    if min(len(truth), len(found)) < 2:
        return [0.0] * 4
    longest, total = [], []
    for ref in tapped(truth):
        used, right = set(), []
        for m, t in enumerate(found):
            good = False
            if ref:
                near = min(range(len(ref)), key=lambda i: (abs(ref[i] - t), i))
                step = lambda x, i, up: (x[i + 1] - x[i] if i + 1 < len(x) else x[i] - x[i - 1] if i else 0) if up else x[i] - x[i - 1]
                up = m == 0 or near == 0
                r, e = step(ref, near, up), step(found, m, up)
                good = near not in used and r > 0 and abs(t - ref[near]) / r < 0.175 and abs(1 - e / r) < 0.175
                if good:
                    used.add(near)
            right.append(good)
        size, run, best = max(len(ref), len(found)), 0, 0
        for g in right:
            run = run + 1 if g else 0
            best = max(best, run)
        longest.append(best / size)
        total.append(sum(right) / size)
    return [longest[0], total[0], max(longest), max(total)]


def cemgil(truth, found, sigma):
    scores = [sum(math.exp(-(min(abs(t - x) for x in found) ** 2) / (2 * sigma**2)) for t in ref) / (0.5 * (len(ref) + len(found))) if found else 0.0 for ref in tapped(truth)] if truth else [0.0]
    return [scores[0], max(scores)]


@pytest.fixture(scope="module")
def tracks(spark):
    rng = random.Random(4)
    truth, found = {}, {}
    for k in range(40):
        period = rng.uniform(0.3, 0.8)
        beats = [6 + i * period + rng.gauss(0, 0.02) for i in range(rng.randrange(1, 40))]
        level = rng.choice([1, 1, 2, 0.5])
        other = beats[::2] if level == 2 else [x for a, b in zip(beats, beats[1:]) for x in (a, (a + b) / 2)] if level == 0.5 else beats
        moved = rng.choice([0, 0, period / 2])
        truth[f"t{k}"] = sorted(beats)
        found[f"t{k}"] = sorted(t + moved + rng.gauss(0, 0.03) for t in other if rng.random() > 0.1)
    truth |= {"only": [6.0, 7.0], "dense": [6 + i * 0.03 for i in range(60)], "one": [6.0], "two": [6.0, 7.0]}
    found |= {"none": [6.0, 7.0], "dense": [6.01 + i * 0.045 for i in range(40)], "one": [6.0], "two": [6.0, 7.0], "only": []}
    of = lambda d: spark.createDataFrame([(k, t) for k, v in d.items() for t in v] + [(None, 7.0)], "name string, at double")
    names = sorted(set(truth) | set(found))
    return of(truth), of(found), {n: (truth.get(n, []), found.get(n, [])) for n in names}


def test_f_measure(tracks):
    truth, found, known = tracks
    got = {r.track: r for r in bm.f_measure(truth, found, "name", "at").collect()}
    assert set(got) == set(known)
    for name, (a, b) in known.items():
        n = pairs(a, b, 0.07)
        assert (got[name].n_truth, got[name].n_found, got[name].n_matched) == (len(a), len(b), n), name
        assert abs(got[name].f_measure - 2 * n / (len(a) + len(b))) < 1e-12


def test_continuity(tracks):
    truth, found, known = tracks
    got = {r.track: r for r in bm.continuity(truth, found, "name", "at").collect()}
    assert set(got) == set(known)
    for name, (a, b) in known.items():
        assert np.allclose([got[name].cml_c, got[name].cml_t, got[name].aml_c, got[name].aml_t], continuity(a, b)), name
    assert got["two"].cml_t == 1 and any(r.aml_t > r.cml_t + 0.5 for r in got.values())


def test_cemgil(tracks):
    truth, found, known = tracks
    got = {r.track: r for r in bm.cemgil(truth, found, "name", "at").collect()}
    for name, (a, b) in known.items():
        assert np.allclose([got[name].cemgil, got[name].cemgil_best], cemgil(a, b, 0.04) if a and b else [0, 0]), name


def test_no_beats(spark, tracks):
    truth, found, _ = tracks
    empty = truth.where("1 = 0")
    for f in (bm.f_measure, bm.continuity, bm.cemgil):
        assert f(empty, empty, "name", "at").count() == 0
        assert {tuple(r)[-1] for r in f(truth, empty, "name", "at").collect()} == {0.0}
    assert bm.trimmed(truth, "at", 6.5).agg(F.min("at")).first()[0] >= 6.5


@pytest.mark.parametrize("n", [1, 5, 20, 21, 34, 100])
def test_frames_and_back(spark, n):
    x = np.arange(1, n + 1).astype(float)
    rows = spark.createDataFrame([("a", x.tolist(), n), ("b", (2 * x).tolist(), n)], "id string, waveform array<double>, n int")
    frames = fragment.framed(rows, 20, 14, lead=3)
    led = np.concatenate([np.zeros(3), x])
    count = max(1, -(-(len(led) - 20) // 14) + 1)
    want = np.pad(led, (0, max(0, (count - 1) * 14 + 20 - len(led))))
    got = {r.frame: r.waveform for r in frames.where("id = 'a'").collect()}
    assert len(got) == count and all((got[k] == want[k * 14 : k * 14 + 20]).all() for k in got)
    flat = fragment.unwrapped(frames, 6, F.col("n"), values="waveform").orderBy("id", "start").collect()
    back = np.concatenate([r.waveform for r in flat if r.id == "b"])
    assert (back == 2 * x[: len(back)]).all() and len(back) >= min(n, count * 14)


def test_stack_and_scaling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 24))
    x[2] = 0
    row = spark.createDataFrame([(x.tolist(),), (np.ones((2, 3)).tolist(),)], "x array<array<double>>")
    power = 10 * np.log10(x**2 + 1e-10)
    want = (power - power.min()) / (power.max() - power.min())
    got = [r[0] for r in row.select(spectra.db_scaled(F.col("x"))).collect()]
    assert np.allclose(got[0], want) and np.allclose(got[1], 0)
    stacked = np.array(row.limit(1).select(spectra.harmonic_stack(F.col("x"), [0.5, 1, 2, 3], 1, 20)).first()[0])
    assert spectra.shifts([0.5, 1, 2, 3, 4, 5, 6, 7], 3) == [-36, 0, 36, 57, 72, 84, 93, 101]
    for h, s in enumerate((-12, 0, 12, 19)):
        wide = np.zeros((5, 80))
        wide[:, 30:54] = x
        assert np.allclose(stacked[h], wide[:, 30 + s : 50 + s])
