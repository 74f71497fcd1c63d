"""Signals as arrays: windows, padding, channels, quantisation. All of it in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_MODES = ("discard", "zero", "repeat", "replicate", "reflect")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f mentions it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def starts(n: Column, chunk, hop, least) -> Column:
    """0, hop, 2 hop ... for windows that hold ``least`` samples at least; none for shorter signals."""
    return F.when(n >= _lit(least), F.sequence(F.lit(0), F.greatest(n - _lit(least), F.lit(0)), _lit(hop))).otherwise(F.array().cast("array<int>"))


def pad(x: Column, size, mode: str) -> Column:
    """Append to ``size`` samples. Repeat and reflect go in passes of at most the length less one; a single sample is repeated."""
    size = _lit(size)
    missing = size - F.size(x)
    if mode == "zero":
        return F.when(missing > 0, F.concat(x, F.array_repeat(F.abs(F.element_at(x, 1) * 0), missing))).otherwise(x)
    if mode == "replicate":
        return F.when(missing > 0, F.concat(x, F.array_repeat(F.element_at(x, -1), missing))).otherwise(x)
    if mode not in ("repeat", "reflect"):
        raise ValueError(f"no padding mode {mode}")

    def once(y: Column, _: Column) -> Column:
        m = F.greatest(F.least(size - F.size(y), F.size(y) - 1), F.lit(0))
        return F.concat(y, F.slice(y, F.lit(1), m) if mode == "repeat" else F.reverse(F.slice(y, F.size(y) - m, m)))

    passes = F.sequence(F.lit(1), F.ceil(F.log2(size.cast("double"))).cast("int") + 1)
    grown = F.aggregate(passes, x, once)
    return F.when(missing <= 0, x).when(F.size(x) == 1, F.array_repeat(F.element_at(x, 1), size)).otherwise(grown)


def centred(x: Column, size, mode: str = "reflect") -> Column:
    """Crop or pad on both sides, the smaller half in front: by mirrored ends (as far as the signal goes, then zeros) or by zeros."""
    if mode not in ("reflect", "zero"):
        raise ValueError(f"no padding mode {mode}")
    n, size = F.size(x), _lit(size)
    front = F.floor(F.abs(size - n) / 2).cast("int")
    back = size - n - front
    zero = F.abs(F.element_at(x, 1) * 0)
    zeros = lambda k: F.array_repeat(zero, F.greatest(k, F.lit(0)))
    if mode == "zero":
        padded = F.concat(zeros(front), x, zeros(back))
    else:
        k, m = F.least(front, n - 1), F.greatest(F.least(back, n - 1), F.lit(0))
        padded = F.concat(zeros(front - k), F.reverse(F.slice(x, F.lit(2), k)), x, F.reverse(F.slice(x, F.greatest(n - m, F.lit(1)), m)), zeros(back - m))
    return F.when(n >= size, F.slice(x, front + 1, size)).when(n == 0, F.array_repeat(F.lit(0.0), size)).otherwise(padded)


def fix_channels(x: Column, channels: int) -> Column:
    """The first ``channels`` of them; too few are repeated in a cycle."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.element_at(x, (i % F.size(x)).cast("int") + 1))


def quantise(x: Column) -> Column:
    """16-bit samples: clamped to [-1, 1], times 32767, cut towards zero."""
    return F.transform(x, lambda v: (F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0)) * F.lit(32767.0)).cast("smallint"))


def dequantise(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") / F.lit(32767.0))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def rms_db(x: Column) -> Column:
    """Level in dB; silence is minus infinity."""
    energy = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(x)
    return F.when(energy > 0, 10 * F.log10(energy)).otherwise(F.lit(float("-inf")))
