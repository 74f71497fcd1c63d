"""Cutting signals into fragments of one length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


@dataclass(frozen=True)
class Windows:
    """Lengths are samples as int, seconds as float. ``overlap`` is a share of the chunk; hop and overlap exclude each other.

    least: windows shorter than this (samples as int, share of the chunk as float) go; with padding "discard" every short one does.
    """

    chunk: int | float
    hop: int | float | None = None
    overlap: float | None = None
    pad: str = "discard"
    least: int | float | None = None
    sr: int = 44100

    def in_seconds(self) -> bool:
        return isinstance(self.chunk, float) or isinstance(self.hop, float)

    def samples(self, sr: int | Column | None = None):
        """Chunk, hop and least window in samples, at a rate (the own one by default) or a column of rates."""
        sr = self.sr if sr is None else sr
        count = lambda v: v if isinstance(v, int) else F.floor(F.lit(v) * sr).cast("int") if isinstance(sr, Column) else int(v * sr)
        if self.hop is not None and self.overlap is not None:
            raise ValueError("give hop or overlap, not both")
        if self.pad not in arrays.PAD_MODES:
            raise ValueError(f"no padding mode {self.pad}")
        if self.overlap is not None and not 0 <= self.overlap < 1:
            raise ValueError("overlap is a share of the chunk: from 0 to below 1")
        chunk = count(self.chunk)
        whole = isinstance(chunk, int)
        share = lambda k, up: (int(round(k * chunk)) if up else int(k * chunk)) if whole else (F.round(k * chunk) if up else F.floor(k * chunk)).cast("int")
        hop = share(1 - self.overlap, True) if self.overlap is not None else chunk if self.hop is None else count(self.hop)
        if (whole and chunk < 1) or (isinstance(hop, int) and hop < 1):
            raise ValueError("chunk and hop are one sample at least")
        least = chunk if self.pad == "discard" and self.least is None else 1 if self.least is None else self.least if isinstance(self.least, int) else share(self.least, False)
        if whole:
            return chunk, hop, max(1, min(least, chunk))
        one = lambda v: F.greatest(v if isinstance(v, Column) else F.lit(v), F.lit(1))
        return one(chunk), one(hop), one(F.least(least if isinstance(least, Column) else F.lit(least), chunk))


def fragments(signals: DataFrame, windows: Windows, signal: str = "waveform", out: str = "waveform") -> DataFrame:
    """A row for each window: the other columns, start (in samples) and the window under ``out``."""
    chunk, hop, least = windows.samples()
    others = [c for c in signals.columns if c not in (signal, out)]
    x = F.col(signal)
    rows = signals.select(*others, x.alias("_x"), F.explode(arrays.starts(F.size(x), chunk, hop, least)).alias("start"))
    window = F.slice("_x", F.col("start") + 1, F.lit(chunk))
    cut = rows.select(*others, "start", window.alias(out))
    return cut if windows.pad == "discard" else cut.withColumn(out, arrays.pad(F.col(out), chunk, windows.pad))


def framed(signals: DataFrame, length: int, hop: int, signal: str = "waveform", lead: int = 0) -> DataFrame:
    """A row for each frame: the other columns, frame (its number) and ``signal`` cut to it; the last one is filled up with zeros.

    lead: zeros in front of the signal. Every sample is in a frame; a signal shorter than one has one frame.
    """
    if length < 1 or hop < 1:
        raise ValueError("length and hop are one sample at least")
    others = [c for c in signals.columns if c not in (signal, "frame")]
    x = F.col(signal)
    zero = F.array_repeat(F.abs(F.element_at(x, 1) * 0), lead)
    led = F.concat(zero, x) if lead else x
    count = F.greatest(F.ceil((F.size("_x") - length) / F.lit(hop)) + 1, F.lit(1)).cast("int")
    rows = signals.where(F.size(x) > 0).select(*others, led.alias("_x")).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame"))
    part = F.slice("_x", F.col("frame") * hop + 1, F.lit(length))
    return rows.select(*others, "frame", arrays.pad(part, length, "zero").alias(signal))


def unwrapped(frames: DataFrame, overlap: int, total: Column, values: str = "values", frame: str = "frame") -> DataFrame:
    """The frames without half of the overlap at either end, so that they stand side by side: adds start, the place of the first value.

    total: a track's number of values; what goes beyond is cut off, and frames that lie beyond it altogether go.
    """
    half = overlap // 2
    kept = F.greatest(F.size(values) - 2 * half, F.lit(0))
    rows = frames.withColumn("start", (F.col(frame) * kept).cast("long"))
    part = F.slice(values, F.lit(half + 1), F.greatest(F.least(kept, (total - F.col("start")).cast("int")), F.lit(0)))
    return rows.withColumn(values, part).where(F.size(values) > 0)


def louder(rows: DataFrame, threshold: float | None, level, signal: str = "waveform") -> DataFrame:
    """Drop windows below the threshold (equal stays), measured on the padded window."""
    return rows if threshold is None else rows.where(level(F.col(signal)) >= threshold)


#: The shipped configurations of two training set-ups, and of the default (seconds).
PRESETS = {
    "default": Windows(1.0, hop=0.5),
    "half_overlap_padded": Windows(262144, hop=131072, pad="zero", least=32000),
    "half_overlap_whole": Windows(524288, hop=262144, pad="discard"),
}
#: Loudness thresholds (LUFS) that go with the presets.
PRESET_LOUDNESS = {"half_overlap_whole": -60.0}
