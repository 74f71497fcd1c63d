"""Notes, peaks and beats as rows: interval joins, local maxima, nearest matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crop_notes(notes: DataFrame, windows: DataFrame, by: str, width: float) -> DataFrame:
    """Notes of each window (by, w_start, w_length), re-based and clipped to it: end > start of the window and start < its end.

    An equi-join on bins of ``width``: a window goes to its bins, a note to those it touches, and a match counts in the
    first bin that both have.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    w = windows.withColumn("w_end", F.col("w_start") + F.col("w_length")).withColumn("bin", F.explode(bins(F.col("w_start"), F.col("w_end"))))
    n = notes.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"))))
    hit = n.join(w, [by, "bin"]).where((F.col("end") > F.col("w_start")) & (F.col("start") < F.col("w_end")))
    hit = hit.where(F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("w_start") / width)))
    return hit.withColumn("note_start", F.greatest(F.col("start") - F.col("w_start"), F.lit(0.0))).withColumn("note_end", F.least(F.col("end") - F.col("w_start"), F.col("w_length"))).drop("bin", "w_end")


def drop_overlaps(notes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds overlaps: a note that begins before one in front has ended, or ends after the next begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return notes.withColumn("overlaps", F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(w) < F.col("end"), F.lit(False)))


def peaks(rows: DataFrame, by: str, order: list[str], value: str, reach: int = 3) -> DataFrame:
    """Rows that equal the largest value within ``reach`` neighbours on each side, and are above 0."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn("_top", F.max(value).over(w)).where((F.col(value) == F.col("_top")) & (F.col(value) > 0)).drop("_top")


def strict_maxima(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def onset_rise(value: Column, w) -> Column:
    """The smaller of the rises over one and two frames, not below 0; 0 for the first two frames."""
    rise = F.least(value - F.lag(value, 1).over(w), value - F.lag(value, 2).over(w))
    return F.when(F.row_number().over(w) <= 2, 0.0).otherwise(F.greatest(rise, F.lit(0.0)))


def merge_close(rows: DataFrame, by: str, time: str, width: float) -> DataFrame:
    """by, peak (from 0 on), time: runs of peaks of which each lies within ``width`` of the running mean of its run, as their means.

    Sequential within ``by``: rows stream through in order, and a run's mean and size are all that is kept.
    """

    def merged(batches):
        now, peak, mean, n = None, 0, 0.0, 0
        for batch in batches:
            out: list[tuple] = []
            for own, t in zip(batch[by].tolist(), batch[time].tolist(), strict=True):
                if n and own == now and t - mean <= width:
                    n += 1
                    mean += (t - mean) / n
                    continue
                if n:
                    out.append((now, peak, mean))
                peak = peak + 1 if n and own == now else 0
                now, mean, n = own, t, 1
            yield pd.DataFrame(out, columns=[by, "peak", time])
        if n:
            yield pd.DataFrame([(now, peak, mean)], columns=[by, "peak", time])

    own = rows.select(by, F.col(time).cast("double").alias(time)).where(F.col(by).isNotNull() & F.col(time).isNotNull())
    return own.repartition(by).sortWithinPartitions(by, time).mapInPandas(merged, f"{by} {rows.schema[by].dataType.simpleString()}, peak int, {time} double")


def nearest(points: DataFrame, beats: DataFrame, by: str, time: str, name: str = "nearest") -> DataFrame:
    """Each point's nearest beat; of two equally near ones the earlier. Two as-of lookups over the union, in one sort."""
    beat = beats.select(by, F.col(time), F.lit(0).alias("_side")).distinct()
    extra = [c for c in points.columns if c not in (by, time)]
    both = points.withColumn("_side", F.lit(1)).unionByName(beat, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side")
    is_beat = F.when(F.col("_side") == 0, F.col(time))
    found = both.withColumn("_before", F.last(is_beat, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.first(is_beat, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    closer = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (F.col(time) - F.col("_before") <= F.col("_after") - F.col(time)), F.col("_before")).otherwise(F.col("_after"))
    return found.where("_side = 1").select(by, time, *extra, closer.alias(name))


def beat_numbers(beats: DataFrame, by: str, order: list[str], downbeat: str) -> DataFrame:
    """Adds beat: place in its bar. A pickup bar counts so that it ends where the first full bar does; where it is not
    shorter than that bar, or fewer than two downbeats are known, it counts from 2 on."""
    w = Window.partitionBy(by).orderBy(*order)
    bar = F.sum(F.col(downbeat).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    barred = beats.withColumn("_bar", bar).withColumn("_k", F.row_number().over(Window.partitionBy(by, "_bar").orderBy(*order)))
    known = barred.groupBy(by).agg(F.max("_bar").alias("_bars"), F.count(F.when(F.col("_bar") == 0, 1)).alias("_pickup"), F.count(F.when(F.col("_bar") == 1, 1)).alias("_first"))
    start = F.when((F.col("_bars") >= 2) & (F.col("_pickup") < F.col("_first")), F.col("_first") - F.col("_pickup")).otherwise(1)
    counted = barred.join(known, by)
    return counted.withColumn("beat", F.when(F.col("_bar") > 0, F.col("_k")).otherwise(start + F.col("_k")).cast("int")).drop("_bar", "_k", "_bars", "_pickup", "_first")


def beat_clock(points: DataFrame, beats: DataFrame, by: str, time: str) -> DataFrame:
    """Adds phase: from 0 at a beat to 1 at the next; null outside the first and the last."""
    both = points.withColumn("_side", F.lit(1)).unionByName(beats.select(by, F.col(time), F.lit(0).alias("_side")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side")
    is_beat = F.when(F.col("_side") == 0, F.col(time))
    low = F.last(is_beat, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(is_beat, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumn("_low", low).withColumn("_high", high).where("_side = 1").withColumn("phase", F.try_divide(F.col(time) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_side", "_low", "_high")


def pitch_class(hz: Column) -> Column:
    """A is 0 to G sharp 11; silence is -1."""
    return F.when(hz > 0, F.pmod(F.round(12 * F.log2(hz / 440.0)).cast("int"), F.lit(12))).otherwise(F.lit(-1))


#: Names of the pitch classes, from -1 on.
PITCH_NAMES = ("X", "A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#")


def pitch_name(cls: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in PITCH_NAMES)), cls + 2)


def pitch_of_name(name: Column) -> Column:
    """The pitch class of a note name such as ``A#3`` or ``G♯-1`` (flats too); -1 for X, null for anything else."""
    root = F.regexp_extract(name, r"^([A-G][#b♯♭]?)(-?\d+)?$", 1)
    letters = {"A": 0, "B": 2, "C": 3, "D": 5, "E": 7, "F": 8, "G": 10}
    base = F.create_map(*(F.lit(v) for pair in letters.items() for v in pair))[F.substring(root, 1, 1)]
    accidental = F.when(F.substring(root, 2, 1).isin("#", "♯"), 1).when(F.substring(root, 2, 1).isin("b", "♭"), -1).otherwise(0)
    return F.when(name == "X", F.lit(-1)).when(root != "", F.pmod(base + accidental, F.lit(12)))
