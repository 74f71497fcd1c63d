"""Features and augmentations that need numpy: vectorised UDFs over array columns, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.keys import uniform


def _each(f: Callable[[np.ndarray], object], kind: str) -> Callable[[Column], Column]:
    """A UDF of one signal; null signals give null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else f(np.asarray(x, float)) for x in batch], dtype=object if "array" in kind else None)

    return run


def _stacked(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A UDF that works on all signals of one length in a batch at once."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            sizes = batch.map(lambda x: -1 if x is None else len(x)).to_numpy()
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                for k, row in zip(at, f(np.stack(batch.iloc[at].to_list()).astype(float)), strict=True):
                    out.iat[k] = row
            for k in np.flatnonzero(sizes == 0):
                out.iat[k] = np.zeros(0)
            yield out

    return run


def loudness(sr: int):
    return _each(lambda x: dsp.loudness(x, sr), "double")


def loudness_of_channels(sr: int):
    """Of a signal of several channels, all of them: array<array>."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else dsp.loudness(np.stack([np.asarray(c, float) for c in x]), sr) for x in batch], dtype=float)

    return run


def loudness_of_channels_at(signals: Column, rates: Column) -> Column:
    """Of signals of several channels (array<array>) at their own rates."""

    @F.pandas_udf("double")
    def run(waves: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else dsp.loudness(np.stack([np.asarray(c, float) for c in x]), int(sr)) for x, sr in zip(waves, own, strict=True)], dtype=float)

    return run(signals, rates)


def mel(sr: int, **options):
    return _each(lambda x: dsp.mel(x, sr, **options).tolist(), "array<array<double>>")


def log_mel(sr: int = 22050):
    return _each(lambda x: dsp.log_mel(x, sr).tolist(), "array<array<double>>")


def cqt(sr: int, **options):
    return _each(lambda x: np.concatenate(dsp.cqt(x, sr, **options)).tolist(), "array<array<double>>")


def f0(sr: int, mode: str = "yin", **options):
    """f0 of each frame, by ``yin`` or ``pyin`` (0 where unvoiced); other modes need libraries that do not come with this one."""
    if mode not in ("yin", "pyin"):
        unavailable(mode)
    return _each((lambda x: dsp.yin(x, sr, **options)) if mode == "yin" else (lambda x: dsp.pyin(x, sr, **options)[0]), "array<double>")


def f0_voiced(sr: int, **options):
    """pyin's two rows: f0, and the chance that a frame is voiced."""
    return _each(lambda x: dsp.pyin(x, sr, **options).tolist(), "array<array<double>>")


def integrator(sr: int):
    return _stacked(lambda x: dsp.integrator(x, sr))


def filtered(kind: str, sr: int, freq: float, q: float = 0.7071067811865476, gain_db: float = 0.0):
    return _stacked(lambda x: dsp.iir(x, *dsp.biquad(kind, sr, freq, q, gain_db)))


def equaliser(sr: int, bands: list[tuple[str, float, float, float]]):
    """A chain of (kind, frequency, q, gain in dB)."""

    def run(x: np.ndarray) -> np.ndarray:
        for kind, freq, q, gain_db in bands:
            x = dsp.iir(x, *dsp.biquad(kind, sr, freq, q, gain_db))
        return x

    return _stacked(run)


def resample(up: int, down: int):
    return _stacked(lambda x: dsp.resample(x, up, down))


def resample_to(sr: int, target: int):
    return resample(target, sr)


def stretch(up: int, down: int, sr: int | None = None):
    return _each(lambda x: dsp.stretch(x, (up, down), sr), "array<double>")


def _drawn(f: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int) -> Callable[[Column, Column, int], Column]:
    """A UDF of a signal and ``count`` uniform numbers from a row's key and a seed: the same wherever the row is."""

    def of(x: Column, key: Column, seed: int = 0) -> Column:
        u = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: uniform(F.concat_ws("/", key, k), seed))

        @F.pandas_udf("array<double>")
        def run(signals: pd.Series, numbers: pd.Series) -> pd.Series:
            return pd.Series([None if s is None else f(np.asarray(s, float), np.asarray(n, float)) for s, n in zip(signals, numbers, strict=True)], dtype=object)

        return run(x, u)

    return of


def random_stretch(sr: int, low: float = 0.7, high: float = 1.3, limit: int = 20, size: int | None = None):
    """By the fraction next to a random ratio; with a size not beyond what keeps so many samples."""
    ratios = dsp.stretch_ratios(limit, low, high)

    def run(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        top = min(high, len(x) / (size or max(1, len(x))))
        return dsp.stretch(x, dsp.nearest_ratio(ratios, low + u[0] * (top - low)), sr)

    return _drawn(run, 1)


def phase_mangle(sr: int, low: float = 20.0, high: float = 2000.0, amplitude: float = 0.99):
    """An all-pass at a log-uniform frequency."""
    return _drawn(lambda x, u: dsp.iir(x, *dsp.pole_filter(dsp.log_uniform(u[0], low, high), sr, amplitude)), 1)


def random_eq(sr: int, bands: int = 2, **options):
    return _drawn(lambda x, u: dsp.random_eq(x, sr, u, bands=bands, **options), 5 + 3 * bands)


def random_distort(sr: int, max_drive: float = 32.0):
    return _drawn(lambda x, u: dsp.random_distort(x, sr, u, max_drive), 13)


def random_mask(n_fft: int = 4096, largest: int = 512):
    """1 to ``largest`` - 1 neighbouring bins at a random place."""

    def run(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        bins = n_fft // 2 + 1
        count = 1 + int(u[0] * (min(largest, bins) - 1))
        return dsp.mask_frequencies(x, int(u[1] * max(1, bins - count)), count, n_fft)

    return _drawn(run, 2)


def random_compress(sr: int, low: float = -60.0, high: float = 0.0, **options):
    """The level that the threshold becomes is drawn between two."""
    return _drawn(lambda x, u: dsp.compress(x, sr, level_db=low + u[0] * (high - low), **options), 1)


def time_stretch(rate: float, n_fft: int = 2048):
    return _each(lambda x: dsp.time_stretch(x, rate, n_fft), "array<double>")


def pitch_shift(semitones: float, n_fft: int = 2048):
    return _each(lambda x: dsp.pitch_shift(x, semitones, n_fft), "array<double>")


def air_absorption(sr: int, metres: float):
    return _each(lambda x: dsp.air_absorption(x, sr, metres), "array<double>")


#: The seven bands' kinds and frequencies.
SEVEN_BANDS = (("lowshelf", 42.0), ("peak", 100.0), ("peak", 250.0), ("peak", 700.0), ("peak", 2000.0), ("peak", 5000.0), ("highshelf", 10000.0))


def seven_bands(sr: int, gains: list[float], q: float = 0.7071067811865476):
    return equaliser(sr, [(kind, min(f, 0.45 * sr), q, g) for (kind, f), g in zip(SEVEN_BANDS, gains, strict=True)])


def loudness_like(sr: int) -> Callable[[Column, Column], Column]:
    """A UDF of two signals: the first at the second's loudness."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else dsp.match_loudness(np.asarray(x, float), np.asarray(y, float), sr) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def mask_frequencies(low: int, count: int, n_fft: int = 4096):
    return _each(lambda x: dsp.mask_frequencies(x, low, count, n_fft), "array<double>")


def compress(sr: int, **options):
    return _stacked(lambda x: dsp.compress(x, sr, **options))


def convolve(response):
    kept = np.asarray(response, float)
    return _each(lambda x: dsp.convolve(x, kept), "array<double>")


def match_loudness(sr: int, target: float):
    """Gain to a loudness; silence stays."""

    def run(x: np.ndarray) -> np.ndarray:
        now = dsp.loudness(x, sr)
        return x if now == dsp.SILENT else x * 10 ** ((target - now) / 20)

    return _each(run, "array<double>")


def add_coloured_noise(exponent: float, level: float, seed: int = 0):
    """Noise of a seed and the signal's own bytes, so that a row always gets the same."""

    def run(x: np.ndarray) -> np.ndarray:
        import zlib

        return x + level * dsp.coloured_noise(len(x), exponent, np.random.default_rng((seed, zlib.crc32(x.tobytes()))))

    return _each(run, "array<double>")


def module(weights, stride: int, bias=None, activation: Callable = np.tanh):
    """A user's own layer over strided frames: weights (dims, width), (dims, frames) out."""
    w = np.asarray(weights, float)
    own = np.zeros((len(w), 1)) if bias is None else np.asarray(bias, float).reshape(-1, 1)

    def run(x: np.ndarray) -> list:
        if len(x) < w.shape[1]:
            return [[] for _ in w]
        parts = np.lib.stride_tricks.sliding_window_view(x, w.shape[1])[::stride]
        return activation(w @ parts.T + own).tolist()

    return _each(run, "array<array<double>>")


def embedding(width: int, dims: int, stride: int, seed: int = 0):
    """A seeded projection of strided frames with a tanh: (dims, frames). Stands for any model with fixed weights."""
    return module(np.random.default_rng(seed).normal(0, 1 / np.sqrt(width), (dims, width)), stride)


def views(x: Column, embed, transforms: list[Callable[[Column], Column]]) -> Column:
    """The embedding of the signal and of each transformed one: 1 + n views."""
    return F.array(embed(x), *(embed(t(x)) for t in transforms))


#: What needs weights, codecs or a renderer that are not part of this library.
UNAVAILABLE = ("pitch transcription network", "beat tracking network", "crepe", "pesto", "world", "praat", "room simulation", "mp3 compression", "dbn post-processing")


def unavailable(name: str):
    """A clear error for those."""
    raise NotImplementedError(f"{name} needs weights or codecs that do not come with this library")
