"""Files that arrive one by one, as a stream into a table or a dataset; signals that arrive in pieces, cut with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import arrays, globs
from ..operators.fragment import Windows
from ..sources import files


def audio_stream(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return found.where(globs.has_extension(F.col("path")) & globs.any_of(F.col("path"), list(include)) & globs.none_of(F.col("path"), list(exclude)))


def ingest(stream: DataFrame, cut, out: str, checkpoint: str):
    """``cut`` turns a batch of files into rows with file_path; files that are stored already are left out."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        fresh = cut(rows)
        try:
            known = spark.read.parquet(out).select("file_path").distinct()
            fresh = fresh.join(known, "file_path", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_dataset(stream: DataFrame, root: str, path: str, checkpoint: str):
    """New files under a root go into a dataset, micro-batch by micro-batch: cut, with its features, keys and index entries.

    A batch is one change of the dataset, and files that are stored already are left out, so one that runs again adds nothing twice.
    """
    from .. import dataset

    def batch(rows: DataFrame, _: int) -> None:
        meta = dataset.Dataset(rows.sparkSession, path).metadata
        dataset.update(rows.sparkSession, path, scanned=files.named(rows, root, meta["include"], meta["exclude"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What ``windows_of_pieces`` takes and gives.
PIECES = "file_path string, seq long, last boolean, samples array<float>"
_CUT = "file_path string, number long, start long, waveform array<float>"


class _Tails(StatefulProcessor):
    """Of each file: the samples that later windows need, where they begin, and the pieces that came too early."""

    def __init__(self, chunk: int, hop: int, least: int):
        self.chunk, self.hop, self.least = chunk, hop, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "x array<float>, begin long, number long, seq long")
        self.early = handle.getMapState("early", "seq long", "x array<float>, last boolean")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        x, begin, number, seq = self.tail.get() if self.tail.exists() else ([], 0, 0, 0)
        held = [np.asarray(x, np.float32)]
        for frame in rows:
            for s, last, samples in zip(frame["seq"], frame["last"], frame["samples"], strict=True):
                if s >= seq:  # a piece that comes again is left out
                    self.early.updateValue((int(s),), ([float(v) for v in samples], bool(last)))
        ended = False
        while not ended and self.early.containsKey((seq,)):
            more, ended = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            held.append(np.asarray(more, np.float32))
            seq += 1
        signal, out = np.concatenate(held), []
        need = self.least if ended else self.chunk
        start = number * self.hop
        while begin + len(signal) - start >= max(need, 1):
            out.append((key[0], number, start, signal[max(0, start - begin) : start - begin + self.chunk]))
            number += 1
            start = number * self.hop
        drop = min(len(signal), max(0, start - begin))
        self.tail.update(([] if ended else [float(v) for v in signal[drop:]], begin + drop, number, seq))
        if out:
            yield pd.DataFrame(out, columns=["file_path", "number", "start", "waveform"])

    def close(self) -> None:
        pass


def windows_of_pieces(pieces: DataFrame, windows: Windows) -> DataFrame:
    """Windows of signals that arrive in pieces (PIECES): file_path, number, start, waveform, the same as if each came whole.

    State is a window's samples a file. Pieces are numbered from 0; one that comes early waits, one that comes again is left out, and the last one
    brings the windows that are filled up. Needs the RocksDB state store.
    """
    chunk, hop, least = windows.samples()
    cut = pieces.groupBy("file_path").transformWithStateInPandas(_Tails(chunk, hop, least), _CUT, "Append", "None")
    return cut if windows.pad == "discard" else cut.withColumn("waveform", arrays.pad(F.col("waveform"), chunk, windows.pad))


def windowed_levels(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Events per window and type, with late ones up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
