"""Matrices of frames and frequency bins as column expressions: decibel scaling, harmonic stacking."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound


def log_base(x: Column, base: float) -> Column:
    return F.ln(x) / math.log(base)


def db_scaled(x: Column, least: float = 1e-10) -> Column:
    """A matrix in decibels of its power, from 0 at its lowest value to 1 at its highest; one that is level is 0 throughout."""

    def scaled(db: Column) -> Column:
        low, high = F.array_min(F.transform(db, F.array_min)), F.array_max(F.transform(db, F.array_max))
        return bound(F.struct(low.alias("low"), (high - low).alias("span")), lambda b: F.transform(db, lambda row: F.transform(row, lambda v: F.coalesce(F.try_divide(v - b["low"], b["span"]), F.lit(0.0)))))

    return bound(F.transform(x, lambda row: F.transform(row, lambda v: 10 * log_base(v.cast("double") * v.cast("double") + least, 10))), scaled)


def shifts(harmonics: list[float], bins_per_semitone: int) -> list[int]:
    """How many bins a harmonic lies above the fundamental."""
    return [round(12 * bins_per_semitone * math.log2(h)) for h in harmonics]


def harmonic_stack(x: Column, harmonics: list[float], bins_per_semitone: int, n_bins: int) -> Column:
    """(harmonics, frames, n_bins): each bin beside the bins of its harmonics, 0 beyond the ends."""
    moved = lambda row, s: F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda k: F.coalesce(F.when(k + s >= 0, F.get(row, (k + s).cast("int"))), F.lit(0.0)))
    one = lambda s: F.transform(x, lambda row: moved(row, s))
    return F.array(*map(one, shifts(harmonics, bins_per_semitone)))
