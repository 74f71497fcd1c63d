"""Audio files and their side files as DataFrames; text and table sinks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, globs
from . import signals

#: Places that are searched for side files, relative to the audio file's folder; fixed values.
SIDE_FOLDERS = (".", "../midi", "./midi", "../MIDI", "./MIDI")


def named(found: DataFrame, root: str, include: list[str] = (), exclude: list[str] = (), content: bool = True) -> DataFrame:
    """Rows of the binary file source under a root, batch or stream, as ``scan`` gives them."""
    path = F.regexp_replace("path", r"^file:/+", "/")
    clean = root.removeprefix("file:").rstrip("/")
    clean = "/" + clean.lstrip("/") if root.startswith(("/", "file:")) else clean
    one = found.select(F.lit(root).alias("root"), path.alias("_p"), "length", *(["content"] if content else []))
    one = one.withColumn("file_path", globs.relative_to_parent(F.col("_p"), clean)).withColumn("relative", F.substring("_p", F.lit(len(clean) + 2), F.length("_p"))).drop("_p")
    return one.where(globs.has_extension(F.col("relative")) & globs.any_of(F.col("relative"), list(include)) & globs.none_of(F.col("relative"), list(exclude)))


def scan(spark: SparkSession, roots: list[str], include: list[str] = (), exclude: list[str] = (), content: bool = True) -> DataFrame:
    """root, file_path (from the root's own folder name on), relative, length, content. No files at all is an error."""
    if not roots:
        raise ValueError("no roots")
    out = None
    for root in roots:
        one = named(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, include, exclude, content)
        out = one if out is None else out.unionByName(one)
    if out.drop("content").isEmpty():
        raise FileNotFoundError(f"no audio files in {', '.join(roots)}")
    return out


def decode(files: DataFrame, sr: int | None = None, channels: int | None = None) -> DataFrame:
    """Adds sr, waveform (channels, samples), file_length (seconds). Files that cannot be read are left out; ``signals.problems`` tells why.

    Wave and AIFF files are decoded; other codecs need libraries that are not part of this one.
    """
    from ..functions.dsp import resample

    @F.pandas_udf("sr int, waveform array<array<float>>")
    def run(data: pd.Series) -> pd.DataFrame:
        rates, waves = [], []
        for d in data:
            try:
                rate, x = signals.decoded(d or b"")
            except signals.Unreadable:
                rates.append(None)
                waves.append(None)
                continue
            if sr and sr != rate:
                x, rate = np.stack([resample(c, sr, rate) for c in x]), sr
            if channels:
                x = x[[k % len(x) for k in range(channels)]]
            rates.append(rate)
            waves.append([c.astype(np.float32) for c in x])
        return pd.DataFrame({"sr": pd.array(rates, dtype="Int32"), "waveform": waves})

    out = files.withColumn("_d", run("content")).drop("content").where("_d.waveform is not null")
    return out.select("*", "_d.sr", "_d.waveform").drop("_d").withColumn("file_length", F.size(F.element_at("waveform", 1)) / F.col("sr"))


def side_files(audio: DataFrame, midi: DataFrame, path: str = "file_path") -> DataFrame:
    """path, midi_path: the side file of the same stem in the first of SIDE_FOLDERS that has one; of several the least name."""
    folder = F.regexp_extract(path, r"^(.*?)/?[^/]*$", 1)
    parent = F.regexp_extract(folder, r"^(.*?)/?[^/]*$", 1)
    join = lambda base, name: F.when(base == "", F.lit(name)).otherwise(F.concat(base, F.lit("/" + name)))
    places = [folder, join(parent, "midi"), join(folder, "midi"), join(parent, "MIDI"), join(folder, "MIDI")]
    wanted = audio.select(F.col(path), globs.stem(F.col(path)).alias("_stem"), F.posexplode(F.array(*places)).alias("_order", "_dir"))
    there = midi.select(F.col(path).alias("midi_path"), globs.stem(F.col(path)).alias("_stem"), folder.alias("_dir"))
    return wanted.join(there, ["_stem", "_dir"]).groupBy(path).agg(F.min_by("midi_path", F.struct("_order", "midi_path")).alias("midi_path"))


def partial(x, sr, start=None, end=None, duration=None, target_sr: int | None = None, channels: int | None = None):
    """Part of a waveform column: from start to end or for a duration (samples as int, seconds as float), then channels and rate."""
    at = lambda v: None if v is None else F.floor(F.lit(v) * sr).cast("int") if isinstance(v, float) else F.lit(v)
    first = at(start) if start is not None else F.lit(0)
    last = at(end) if end is not None else first + at(duration) if duration is not None else None
    part = F.transform(x, lambda c: F.slice(c, first + 1, F.greatest((F.size(c) if last is None else last) - first, F.lit(0))))
    if channels:
        part = arrays.fix_channels(part, channels)
    if target_sr is None:
        return part
    from ..functions.dsp import resample

    @F.pandas_udf("array<array<float>>")
    def moved(waves: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else [resample(np.asarray(c, float), target_sr, int(r)).astype(np.float32) for c in w] for w, r in zip(waves, rates, strict=True)], dtype=object)

    return moved(part, sr)


def write_wave(rows: DataFrame, folder: str, sr: int) -> int:
    """Files of 16-bit mono samples, one for each row (name, waveform); gives their number. A task that runs again writes the same files."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = signals.opened(f"{folder.rstrip('/')}/{r['name']}")
                x = np.clip(np.floor(np.asarray(r["waveform"] or [], float) * 32768), -32768, 32767).astype("<i2").tobytes()
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(x), b"WAVE", b"fmt ", 16, 1, 1, sr, 2 * sr, 2, 16, b"data", len(x)) + x)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return rows.select("name", "waveform").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def output_names(inputs: DataFrame, folder: str, tag: str, path: str = "file_path", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds output: ``folder/<stem>_<tag>`` for each input; ``clash`` tells which of several inputs of one name would write over another's.
    The first path does not; of inputs with one path, the first by ``ties``, without which it may be any of them."""
    named = inputs.withColumn("output", F.concat(F.lit(folder.rstrip("/") + "/"), globs.stem(F.col(path)), F.lit(f"_{tag}")))
    return named.withColumn("clash", F.row_number().over(Window.partitionBy("output").orderBy(path, *ties)) > 1)


def outstanding(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet: skips what an earlier run has done."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def by_suffix(paths: DataFrame, known: DataFrame, path: str = "file_path", full: str = "full_path") -> DataFrame:
    """path, full: the known path that ends with it at a folder's start, the shortest of several. By an equi-join on the last name."""
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    hit = paths.withColumn("_name", last(path)).join(known.select(F.col(full), last(full).alias("_name")), "_name")
    ends = (F.col(full) == F.col(path)) | F.col(full).endswith(F.concat(F.lit("/"), F.col(path)))
    return hit.where(ends).groupBy(path).agg(F.min_by(full, F.struct(F.length(full), full)).alias(full))
