"""Notes from activations, frame by frame: rows (track, frame, arrays by pitch or contour bin).

Onsets, amplitudes, bends and times are windows, joins and array expressions over frames. Only the tracing of notes, where each
note takes away energy that the next ones would use, goes through a track in order (``functions.notes.trace``), on the track's
energies and onset peaks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import notes as kernels


def frames_of(rows: DataFrame, by: str, **matrices: Column) -> DataFrame:
    """track, frame and an array for each matrix (an array of frames): a row a frame."""
    zipped = F.arrays_zip(*(c.alias(n) for n, c in matrices.items()))
    each = rows.select(F.col(by).alias("track"), F.posexplode(zipped).alias("frame", "_v"))
    return each.select("track", "frame", *(F.col("_v")[str(k)].alias(n) if str(k) in each.schema["_v"].dataType.names else F.col("_v")[n].alias(n) for k, n in enumerate(matrices)))


def between(x: Column, low: float | None, high: float | None) -> Column:
    """An array by pitch with zeros below the pitch of ``low`` and from that of ``high`` on."""
    row = lambda hz: round(12 * math.log2(hz / 440) + 69 - kernels.LOWEST)
    first, last = row(low) if low is not None else None, row(high) if high is not None else None
    kept = lambda i: (F.lit(True) if first is None else i >= first) & (F.lit(True) if last is None else i < max(0, last))
    return x if low is None and high is None else F.transform(x, lambda v, i: F.when(kept(i), v).otherwise(v * 0))


def infer_onsets(frames: DataFrame, steps: int = 2) -> DataFrame:
    """``onsets`` become the larger of themselves and the energies' rises over one to ``steps`` frames, these at the onsets' largest value."""
    w = Window.partitionBy("track").orderBy("frame")
    rise = F.transform("energy", lambda v: v * 0 + float("inf"))
    for k in range(1, steps + 1):
        rise = F.zip_with(rise, F.zip_with("energy", F.lag("energy", k).over(w), lambda a, b: a - F.coalesce(b, F.lit(0.0))), lambda a, b: F.least(a, b))
    at = F.row_number().over(w)
    risen = frames.withColumn("_rise", F.when(at > steps, F.transform(rise, lambda v: F.greatest(v, F.lit(0.0)))).otherwise(F.transform("energy", lambda v: v * 0)))
    tops = risen.groupBy("track").agg((F.max(F.array_max("onsets")) / F.nullif(F.max(F.array_max("_rise")), F.lit(0.0))).alias("_scale"))
    larger = F.zip_with("onsets", "_rise", lambda o, r: F.greatest(o, r * F.coalesce("_scale", F.lit(0.0))))
    return risen.join(tops, "track").withColumn("onsets", larger).drop("_rise", "_scale")


def onset_peaks(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """track, frame, pitch (from 0): where an onset is above those of the frames beside it, and the threshold is reached. A track's first and last frame have none."""
    w = Window.partitionBy("track").orderBy("frame")
    sides = frames.withColumn("_a", F.lag("onsets").over(w)).withColumn("_b", F.lead("onsets").over(w)).where("_a is not null and _b is not null")
    high = F.filter(F.sequence(F.lit(0), F.size("onsets") - 1), lambda p: (F.get("onsets", p) > F.get("_a", p)) & (F.get("onsets", p) > F.get("_b", p)) & (F.get("onsets", p) >= threshold))
    return sides.where(F.size("onsets") > 0).select("track", "frame", F.explode(high).alias("pitch"))


def trace(frames: DataFrame, peaks: DataFrame, frame: float = 0.3, least: int = 11, melodia: bool = True, tolerance: int = 11) -> DataFrame:
    """track, start, end, pitch (frames, from 0): notes from their onsets and, with ``melodia``, from what energy is left. A track is one task's work."""
    kind = frames.schema["track"].dataType.simpleString()

    def run(own: pd.DataFrame, onsets: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"track": [], "start": [], "end": [], "pitch": []})
        own = own.sort_values("frame")
        energy = np.stack([np.asarray(e, float) for e in own["energy"]])
        places = sorted(zip((onsets["at"] - own["frame"].iloc[0]).tolist(), onsets["p"].tolist(), strict=True))
        found = kernels.trace(energy, places, frame, least, melodia, tolerance) if len(energy) > 2 else []
        low = int(own["frame"].iloc[0])
        return pd.DataFrame([(own["track"].iloc[0], s + low, e + low, p) for s, e, p in found], columns=["track", "start", "end", "pitch"])

    asked = peaks.select(F.col("track").alias("of"), F.col("frame").alias("at"), F.col("pitch").alias("p"))
    return frames.select("track", "frame", "energy").groupBy("track").cogroup(asked.groupBy("of")).applyInPandas(run, f"track {kind}, start int, end int, pitch int")


def _note_frames(notes: DataFrame, frames: DataFrame, column: str) -> DataFrame:
    """A row for each note's frame, with that frame's array."""
    each = notes.select("track", "start", "end", "pitch", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"))
    return each.join(frames.select("track", "frame", column), ["track", "frame"])


def amplitudes(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds amplitude: the mean energy of the note's pitch over its frames."""
    of = _note_frames(notes.where("end > start"), frames, "energy").groupBy("track", "start", "end", "pitch").agg(F.avg(F.get("energy", F.col("pitch"))).alias("amplitude"))
    return notes.join(of, ["track", "start", "end", "pitch"])


def bends(notes: DataFrame, frames: DataFrame, reach: int = 25, spread: float = 5.0) -> DataFrame:
    """Adds bends: frame by frame, how many bins the strongest contour lies off the note's pitch, near ones preferred by a bell; the first of equals."""
    centres = F.array(*(F.lit(int(np.round(kernels.contour_bin(p + kernels.LOWEST)))) for p in range(kernels.PITCHES)))
    own = _note_frames(notes.where("end > start"), frames, "contours").withColumn("centre", F.get(centres, F.col("pitch")))
    low, high = F.greatest(F.col("centre") - reach, F.lit(0)), F.least(F.col("centre") + reach + 1, F.size("contours"))
    part = F.slice("contours", low + 1, F.greatest(high - low, F.lit(0)))
    off = low - F.col("centre")
    weighed = F.transform(part, lambda v, i: v * F.exp(-0.5 * ((i + off) / F.lit(spread)) * ((i + off) / F.lit(spread))))
    best = own.withColumn("_w", weighed).withColumn("_b", (F.array_position("_w", F.array_max("_w")) - 1 + off).cast("int"))
    of = best.groupBy("track", "start", "end", "pitch").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "_b"))), lambda r: r["_b"]).alias("bends"))  # as many as the note has frames
    return notes.join(of, ["track", "start", "end", "pitch"])


def frame_seconds(frame: Column) -> Column:
    """The time of a frame, with the correction of windows that overlap."""
    late = kernels.HOP / kernels.RATE * (kernels.WINDOW_FRAMES - kernels.WINDOW_SAMPLES / kernels.HOP) + kernels.LATE
    return frame * (kernels.HOP / kernels.RATE) - late * F.floor(frame / kernels.WINDOW_FRAMES)


def decode(frames: DataFrame, onset: float = 0.5, frame: float = 0.3, least: int = 11, infer: bool = True, low: float | None = None, high: float | None = None, melodia: bool = True, tolerance: int = 11) -> DataFrame:
    """track, start, end (frames), start_s, end_s, pitch (MIDI), amplitude and, where frames have ``contours``, bends."""
    kept = frames.withColumn("energy", between(F.col("energy"), low, high)).withColumn("onsets", between(F.col("onsets"), low, high))
    ready = infer_onsets(kept) if infer else kept
    found = amplitudes(trace(ready, onset_peaks(ready, onset), frame, least, melodia, tolerance), ready)
    found = bends(found, frames) if "contours" in frames.columns else found
    return found.withColumn("start_s", frame_seconds(F.col("start"))).withColumn("end_s", frame_seconds(F.col("end"))).withColumn("pitch", F.col("pitch") + kernels.LOWEST)
