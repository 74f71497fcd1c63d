"""Notes as rows: decoded from activations, read from MIDI files, cropped to fragments, written to files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes as kernels

NOTE = "array<struct<start:double,end:double,pitch:int,amplitude:double,bends:array<int>>>"


def decoded(frames: Column, onsets: Column, contours: Column | None = None, seconds: bool = True, **options) -> Column:
    """Notes of a row's activation matrices (arrays of frames of pitches): in seconds or frames, with bends where contours are given."""

    @F.pandas_udf(NOTE)
    def run(f: pd.Series, o: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for frame, onset, contour in zip(f, o, c, strict=True):
            if frame is None or onset is None:
                out.append(None)
                continue
            found = kernels.decode(np.stack(frame) if len(frame) else np.zeros((0, kernels.PITCHES)), np.stack(onset) if len(onset) else np.zeros((0, kernels.PITCHES)), **options)
            bent = kernels.bends(np.stack(contour), found) if contour is not None and len(contour) else [None] * len(found)
            times = kernels.frame_times(len(frame) + 1) if seconds else np.arange(len(frame) + 1, dtype=float)
            out.append([{"start": float(times[s]), "end": float(times[e]), "pitch": p, "amplitude": a, "bends": b} for (s, e, p, a), b in zip(found, bent, strict=True)])
        return pd.Series(out, dtype=object)

    return run(frames, onsets, F.lit(None).cast("array<array<double>>") if contours is None else contours)


def drop_bends(notes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Bends go from notes that overlap another one in time."""
    from .events import drop_overlaps

    return drop_overlaps(notes, by, order).withColumn("bends", F.when(~F.col("overlaps"), F.col("bends"))).drop("overlaps")


def midi_of(notes: Column) -> Column:
    """A MIDI file of a row's notes (start, end, pitch, amplitude, bends)."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        of = lambda n: (n["start"], n["end"], n["pitch"], n["amplitude"], None if n["bends"] is None else list(n["bends"]))
        return pd.Series([None if r is None else kernels.build_midi([of(n) for n in r]) for r in rows], dtype=object)

    return run(notes)


def notes_of(data: Column) -> Column:
    """The notes of MIDI files' bytes; null where a file cannot be read."""

    def one(d):
        try:
            return None if d is None else [dict(zip(("start", "end", "pitch", "velocity"), n, strict=True)) for n in kernels.parse_midi(bytes(d))]
        except (ValueError, IndexError):
            return None

    @F.pandas_udf("array<struct<start:double,end:double,pitch:int,velocity:int>>")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([one(d) for d in files], dtype=object)

    return run(data)


def cropped(notes: Column, start: Column, length: Column) -> Column:
    """An array of notes within a window: those that end after its start and start before its end, from its start on, cut at its end."""
    hit = F.filter(notes, lambda n: (n["end"] > start) & (n["start"] < start + length))
    return F.transform(hit, lambda n: n.withField("start", F.greatest(n["start"] - start, F.lit(0.0))).withField("end", F.least(n["end"] - start, length)))


def with_notes(fragments: DataFrame, midi: DataFrame, path: str = "file_path") -> DataFrame:
    """Adds notes to fragments (path, start_pos, length) from side files (path, midi_path, content); none without a side file.

    Files join by path with their fragments; every fragment takes the notes of its own window.
    """
    read = midi.select(path, notes_of(F.col("content")).alias("_notes"))
    joined = fragments.join(read, path, "left")
    own = cropped(F.col("_notes"), F.col("start_pos"), F.col("length"))
    return joined.withColumn("notes", F.coalesce(own, F.array().cast("array<struct<start:double,end:double,pitch:int,velocity:int>>"))).drop("_notes")


def write_notes(notes: DataFrame, path: str) -> None:
    """CSV: start_time_s, end_time_s, pitch_midi, velocity (127 times the amplitude, rounded), pitch_bend (as a list)."""
    bent = F.coalesce(F.array_join(F.col("bends").cast("array<string>"), ","), F.lit("")) if "bends" in notes.columns else F.lit("")
    notes.select(F.col("start").alias("start_time_s"), F.col("end").alias("end_time_s"), F.col("pitch").alias("pitch_midi"), F.round(127 * F.col("amplitude")).cast("int").alias("velocity"), bent.alias("pitch_bend")).write.mode("overwrite").csv(path, header=True)
