"""Notes decoded frame by frame in Spark, against the decoder of whole matrices."""

import numpy as np
from pyspark.sql import functions as F

from sonolith.functions import notes as kernels
from sonolith.operators import note_frames as nf


def test_decoding_equals_that_of_matrices(spark):
    rng = np.random.default_rng(5)
    tracks = {}
    for name, n in (("a", 120), ("b", 60), ("c", 3), ("d", 2)):
        energy = rng.random((n, 88)) * 0.25
        for _ in range(n // 6):
            s, p, size = rng.integers(n), rng.integers(88), rng.integers(3, 30)
            energy[s : s + size, p] = rng.random() * 0.6 + 0.35
        onsets = np.clip(np.diff(energy, axis=0, prepend=0), 0, 1)
        tracks[name] = energy, onsets, rng.random((n, 264))
    rows = spark.createDataFrame([(k, *(x.tolist() for x in v)) for k, v in tracks.items()], "name string, e array<array<double>>, o array<array<double>>, c array<array<double>>")
    frames = nf.frames_of(rows, "name", energy=F.col("e"), onsets=F.col("o"), contours=F.col("c"))
    for options in ({}, {"infer": False, "onset": 0.3}, {"melodia": False, "least": 4}, {"low": 60.0, "high": 900.0, "tolerance": 5}):
        got = nf.decode(frames, **options).collect()
        for name, (energy, onsets, contours) in tracks.items():
            want = kernels.decode(energy, onsets, **options)
            mine = sorted((r.start, r.end, r.pitch, r.amplitude) for r in got if r.track == name)
            assert [x[:3] for x in mine] == [x[:3] for x in want], (name, options)
            assert np.allclose([x[3] for x in mine], [x[3] for x in want])
            bent = {(r.start, r.end, r.pitch): r.bends for r in got if r.track == name}
            assert [bent[x[:3]] for x in want] == kernels.bends(contours, want)
    times = kernels.frame_times(500)
    assert np.allclose([r[0] for r in spark.range(500).select(nf.frame_seconds(F.col("id"))).collect()], times)
    assert nf.decode(frames.where("1 = 0")).count() == 0
