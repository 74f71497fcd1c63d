"""Beats from activations: the minimal post-processing, chunks of a piece and their stitching, beat clocks of fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import events


def minimal(rows: DataFrame, by: str, frame: str, beat: str = "beat", downbeat: str = "downbeat", fps: float = 50.0, reach: int = 3, width: float | None = 1.0) -> DataFrame:
    """by, kind (beat, downbeat), time: logits above 0 that are the largest within ``reach`` frames; peaks of which each lies within
    ``width`` frames of its run's mean as that mean (None: each peak for itself, also on plateaus); downbeats at their nearest beat
    (where there are beats), each once. Null logits are padding."""
    found = {}
    for kind, column in (("beat", beat), ("downbeat", downbeat)):
        own = rows.where(F.col(column).isNotNull()).select(by, frame, F.col(column).alias("_v"))
        peaks = events.peaks(own, by, [frame], "_v", reach)
        merged = peaks if width is None else events.merge_close(peaks, by, frame, width)
        found[kind] = merged.select(by, (F.col(frame) / fps).alias("time"))
    near = events.nearest(found["downbeat"], found["beat"], by, "time")
    down = near.select(by, F.coalesce("nearest", "time").alias("time")).distinct()
    return found["beat"].select(by, F.lit("beat").alias("kind"), "time").unionByName(down.select(by, F.lit("downbeat").alias("kind"), "time"))


def chunk_starts(n: Column, size: int = 1500, border: int = 6) -> Column:
    """Where chunks of a piece of n frames begin: they overlap by their borders, and the last one ends at the piece's end."""
    inner = size - 2 * border
    starts = F.sequence(F.lit(-border), F.greatest(n - border - 1, F.lit(-border)), F.lit(inner))
    moved = F.concat(F.slice(starts, F.lit(1), F.size(starts) - 1), F.array((n - (size - border)).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n > inner, moved).otherwise(starts)


def stitched(chunks: DataFrame, by: str, start: str, values: list[str], size: int = 1500, border: int = 6, keep_first: bool = True) -> DataFrame:
    """by, frame, values: of chunks (arrays of frames under ``values``) without their borders; of overlapping ones the first counts, or the last."""
    kept = F.slice(F.arrays_zip(*values), border + 1, size - 2 * border)
    inner = chunks.select(by, start, F.posexplode(kept).alias("_k", "_v")).withColumn("frame", F.col(start) + F.col("_k") + border).where("frame >= 0")
    pick = (F.min_by if keep_first else F.max_by)("_v", start)
    return inner.groupBy(by, "frame").agg(pick.alias("_v")).select(by, "frame", *(F.col("_v")[v].alias(v) for v in values))


def ramp(beats: np.ndarray, seconds: float, n: int) -> np.ndarray:
    """Phases at n places over a window: from 0 at a beat (or the window's start) to 1 at the next; 0 after the last beat and with fewer than three."""
    times = np.linspace(0, seconds, n)
    beats = np.asarray(beats, float)
    beats = beats[beats < seconds]
    if len(beats) < 3 or not n:
        return np.zeros(n)
    edges = np.unique(np.concatenate([[0.0], beats]))
    k = np.searchsorted(edges, times, "right") - 1
    inside = k < len(edges) - 1
    k = np.minimum(k, len(edges) - 2)
    return np.where(inside, (times - edges[k]) / (edges[k + 1] - edges[k]), 0.0)


def clocks(beats: Column, downbeats: Column, start: Column, length: Column, n: Column) -> Column:
    """Of a fragment two rows of n phases: of its beats and of its downbeats (arrays of seconds in the file)."""

    @F.pandas_udf("array<array<double>>")
    def run(b: pd.Series, d: pd.Series, s: pd.Series, seconds: pd.Series, many: pd.Series) -> pd.Series:
        rows = zip(b, d, s, seconds, many, strict=True)
        return pd.Series([[ramp(np.asarray([] if x is None else [t - at for t in x if t >= at]), size, int(k)) for x in (beat, down)] for beat, down, at, size, k in rows], dtype=object)

    return run(beats, downbeats, start, length, n)


def frames_of(indexes: Column, n: Column) -> Column:
    """Booleans of n frames, true at the indexes: runs of false that end with true, one after the other."""
    no = lambda k: F.array_repeat(F.lit(False), k.cast("int"))

    def joined(known: Column) -> Column:
        runs = F.transform(known, lambda v, k: F.concat(no(v - F.coalesce(F.get(known, k - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
        return F.concat(F.flatten(runs), no(n - F.coalesce(F.get(known, F.size(known) - 1), F.lit(-1)) - 1))

    return arrays.bound(F.array_sort(F.array_distinct(F.filter(indexes, lambda v: (v >= 0) & (v < n)))), joined)


def augmentation(name: Column) -> Column:
    """shift and stretch (null without) from tags such as ``_ps3_ts-2`` in a file's name."""
    of = lambda tag: F.regexp_extract(name, rf"_{tag}(-?\d+)(?=[_.]|$)", 1).try_cast("int")
    return F.struct(of("ps").alias("shift"), of("ts").alias("stretch"))


def write_beats(beats: DataFrame, path: str, time: str = "time") -> None:
    """TSV: time and place in the bar (``events.beat_numbers``)."""
    beats.select(time, "beat").write.mode("overwrite").csv(path, sep="\t")
