"""Long PCM files cut by byte ranges: ``windows`` for a scanned table of files, ``format("signal_windows")`` for folders.

A long file is the work of many tasks; small files share them. A task reads a file's header first, by a range of a few
bytes, takes its share of the file's windows and reads the frames that those span, a few megabytes at a time; no array
holds a file. Wave (also RF64 and the extensible form) and AIFF / AIFC files are read: integers of 8 to 32 bits and
floats. A file that cannot be read gives one row that says why in ``problem``, and no windows.
"""

from __future__ import annotations

import dataclasses
import json
import re
import struct
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions import globs

if TYPE_CHECKING:
    from ..operators.fragment import Windows

#: Bytes of a file that one task reads, and of frames that it holds.
SPLIT, HELD = 64 << 20, 4 << 20
#: Small ranges share a task: so many of at most so many bytes.
SHARED, SMALL = 64, 64 << 10
SCHEMA = "file_path string, sr int, channels int, n_frames long, start long, waveform array<array<float>>, problem string"
_ARROW = pa.schema([("file_path", pa.string()), ("sr", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()), ("start", pa.int64()), ("waveform", pa.list_(pa.list_(pa.float32()))), ("problem", pa.string())])
Read = Callable[[int, int], bytes]


@dataclasses.dataclass(frozen=True)
class Sound:
    """How a file's frames are stored: numpy type and byte order, bytes a sample, where they begin, how many there are."""

    sr: int
    channels: int
    width: int
    floats: bool
    big: bool
    offset: int
    frames: int

    @property
    def frame(self) -> int:
        return self.width * self.channels


class Unreadable(ValueError):
    """Why a file cannot be decoded."""


def _sound(sr: int, channels: int, bits: int, floats: bool, big: bool, offset: int, size: int) -> Sound:
    width = -(-bits // 8)
    if sr < 1 or channels < 1 or width not in ((4, 8) if floats else (1, 2, 3, 4)):
        raise Unreadable(f"{channels} channels of {bits} bits at {sr} Hz")
    return Sound(sr, channels, width, floats, big, offset, max(0, size) // (width * channels))


def _chunks(read: Read, size: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= size:
        name, length = struct.unpack(order + "4sI", read(at, 8))
        yield name, at + 8, length
        at += 8 + length + length % 2


def _wave(read: Read, size: int) -> Sound:
    form, long_data = None, None
    for name, at, length in _chunks(read, size, "<"):
        if name == b"ds64":
            long_data = struct.unpack("<Q", read(at + 8, 8))[0]
        elif name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at, 16))
            if tag == 0xFFFE:
                tag = struct.unpack("<H", read(at + 24, 2))[0]
            form = tag, channels, rate, bits
        elif name == b"data":
            if form is None or form[0] not in (1, 3):
                raise Unreadable("no format" if form is None else f"wave format {form[0]} is not PCM")
            length = long_data if length == 0xFFFFFFFF and long_data is not None else length
            held = size - at if length in (0, 0xFFFFFFFF) else min(length, size - at)
            return _sound(form[2], form[1], form[3], form[0] == 3, False, at, held)
    raise Unreadable("no samples")


def _aiff(read: Read, size: int) -> Sound:
    form, place = None, None
    for name, at, length in _chunks(read, size, ">"):
        if name == b"COMM":
            channels, frames, bits, exponent, mantissa = struct.unpack(">hIhHQ", read(at, 18))
            kind = read(at + 18, 4) if length >= 22 else b"NONE"
            form = channels, frames, bits, round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)), kind
        elif name == b"SSND":
            place = at + 8 + struct.unpack(">I", read(at, 4))[0], length
    if form is None or place is None:
        raise Unreadable("no samples")
    channels, frames, bits, rate, kind = form
    if kind.lower() not in (b"none", b"sowt", b"twos", b"fl32", b"fl64"):
        raise Unreadable(f"AIFF compression {kind.decode('latin-1')} is not PCM")
    sound = _sound(rate, channels, bits, kind.lower().startswith(b"fl"), kind.lower() != b"sowt", place[0], size - place[0])
    return dataclasses.replace(sound, frames=min(sound.frames, frames))


def header(read: Read, size: int) -> Sound:
    """What the first bytes of a file say. ``read(at, n)`` gives n bytes from a place on (fewer at the end)."""
    try:
        begin = read(0, 12)
        if begin[:4] in (b"RIFF", b"RF64") and begin[8:] == b"WAVE":
            return _wave(read, size)
        if begin[:4] == b"FORM" and begin[8:] in (b"AIFF", b"AIFC"):
            return _aiff(read, size)
    except struct.error:
        raise Unreadable("the file ends within its header") from None
    raise Unreadable("neither wave nor AIFF")


def samples(sound: Sound, raw: bytes) -> np.ndarray:
    """(channels, frames) in [-1, 1]; floats are as they are."""
    raw = raw[: len(raw) // sound.frame * sound.frame]
    order = ">" if sound.big else "<"
    if sound.floats:
        x = np.frombuffer(raw, f"{order}f{sound.width}").astype(float)
    elif sound.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if sound.big else b
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
    elif sound.width == 1:
        x = np.frombuffer(raw, np.int8) / 128 if sound.big else (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, f"{order}i{sound.width}") / 2 ** (8 * sound.width - 1)
    return x.reshape(-1, sound.channels).T


def decoded(data: bytes) -> tuple[int, np.ndarray]:
    """A whole file: its rate and samples."""
    sound = header(lambda at, n: data[at : at + n], len(data))
    return sound.sr, samples(sound, data[sound.offset : sound.offset + sound.frames * sound.frame])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ``file:/x``, ``file:///x`` and ``/x`` mean the same."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _reader(file) -> Read:
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def cut(uri: str, name: str, windows: Windows, part: int = 0, parts: int = 1, low: int = 0, high: int | None = None) -> Iterator[pa.RecordBatch]:
    """Windows that start at a frame from ``low`` on and below ``high``: the share of one of so many parts of them."""

    def batch(sound: Sound | None, starts: list, waves: list, problem: str | None = None) -> pa.RecordBatch:
        n = len(starts)
        of = lambda v: [v] * n
        columns = [of(name), of(sound and sound.sr), of(sound and sound.channels), of(sound and sound.frames), starts, waves, of(problem)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    try:
        system, path = opened(uri)
        with system.open_input_file(path) as file:
            read = _reader(file)
            sound = header(read, file.size())
            chunk, hop, least = windows.samples(sound.sr)
            count = (sound.frames - least) // hop + 1 if sound.frames >= least else 0
            first, last = min(count, max(0, -(-low // hop))), count if high is None else max(0, min(count, -(-high // hop)))
            size = max(0, last - first)
            k, end = first + part * size // parts, first + (part + 1) * size // parts
            at_once = max(1, (HELD // sound.frame - chunk) // hop + 1)
            while k < end:
                some = range(k, min(end, k + at_once))
                begin = some[0] * hop
                stop = min(sound.frames, some[-1] * hop + chunk)
                held = samples(sound, read(sound.offset + begin * sound.frame, (stop - begin) * sound.frame)).astype(np.float32)
                yield batch(sound, [j * hop for j in some], [list(held[:, j * hop - begin : j * hop - begin + chunk]) for j in some])
                k = some[-1] + 1
    except (Unreadable, OSError) as e:
        if part == 0:
            yield batch(None, [None], [None], str(e))


def _uri() -> Column:
    return F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), F.col("relative"))


def windows(files: DataFrame, cutting: Windows, low: int = 0, high: int | None = None, split: int = SPLIT) -> DataFrame:
    """SCHEMA and root, for files (root, file_path, relative, length) as ``scan(content=False)`` gives them: dealt by byte ranges, about one a task, of small ones SHARED."""
    parts = F.greatest(F.ceil(F.col("length") / split), F.lit(1)).cast("int")
    named = files.select("root", _uri().alias("uri"), "file_path", parts.alias("parts"), (F.col("length") / parts <= SMALL).alias("small"))
    large, small = named.agg(*(F.coalesce(F.sum(F.when(which, F.col("parts"))), F.lit(0)) for which in (~F.col("small"), F.col("small")))).first()
    tasks = max(1, large + -(-small // SHARED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for some in cut(r["uri"], r["file_path"], cutting, r["part"], r["parts"], low, high):
                    yield some.append_column("root", pa.array([r["root"]] * some.num_rows, pa.string()))

    ranges = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return ranges.repartition(tasks).mapInArrow(run, SCHEMA + ", root string")


def problems(files: DataFrame) -> DataFrame:
    """file_path, problem: files that cannot be decoded, and why, by their headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                try:
                    system, path = opened(r["uri"])
                    with system.open_input_file(path) as file:
                        header(_reader(file), file.size())
                except (Unreadable, OSError) as e:
                    found.append((r["file_path"], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["file_path", "problem"])

    return files.select(_uri().alias("uri"), "file_path").mapInArrow(run, "file_path string, problem string")


@dataclasses.dataclass(frozen=True)
class _Range:
    uri: str
    name: str
    part: int
    parts: int


@dataclasses.dataclass
class _Task(InputPartition):
    """A large range, or small ones of several files."""

    ranges: list[_Range]

    @property
    def name(self) -> str:
        return self.ranges[0].name


class SignalWindows(DataSource):
    """Options: path; windows (the fields of ``Windows`` as JSON); include, exclude (a glob each); split_bytes. Comparisons of ``start`` and equality of ``file_path`` are pushed down."""

    @classmethod
    def name(cls) -> str:
        return "signal_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high, self.only = options, 0, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            value = getattr(f, "value", None)
            if f.attribute == ("start",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    upper = value + (not isinstance(f, LessThan))
                    self.high = upper if self.high is None else min(self.high, upper)
                yield f  # a file that cannot be read has no start: Spark drops its row
            elif isinstance(f, EqualTo) and f.attribute == ("file_path",):
                self.only = value
                yield f
            else:
                yield f

    def partitions(self) -> list[_Task]:
        root, split = self.options["path"].rstrip("/"), int(self.options.get("split_bytes", SPLIT))
        system, path = opened(root)
        fits = [re.compile(globs.file_regex(self.options[o])) if self.options.get(o) else None for o in ("include", "exclude")]
        known = re.compile(globs.extension_regex())
        out, small = [], []
        for f in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path):
            relative = f.path[len(path) :].lstrip("/")
            name = f"{path.rsplit('/', 1)[-1]}/{relative}"
            wanted = f.is_file and known.search(relative) and (self.only is None or name == self.only)
            if not wanted or (fits[0] and not fits[0].search(relative)) or (fits[1] and fits[1].search(relative)):
                continue
            parts = max(1, -(-f.size // split))
            ranges = [_Range(f"{root}/{relative}", name, k, parts) for k in range(parts)]
            if f.size > parts * SMALL:
                out += [_Task([r]) for r in ranges]
            else:
                small += ranges
        return out + [_Task(small[k : k + SHARED]) for k in range(0, len(small), SHARED)]

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        from ..operators.fragment import Windows

        cutting = Windows(**json.loads(self.options["windows"]))
        for r in partition.ranges:
            yield from cut(r.uri, r.name, cutting, r.part, r.parts, self.low, self.high)


def source(spark: SparkSession, path: str, cutting: Windows, **options) -> DataFrame:
    """The data source over a folder, with filters pushed down."""
    spark.dataSource.register(SignalWindows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("signal_windows").options(windows=json.dumps(dataclasses.asdict(cutting)), **options).load(path)


def ranges(spark: SparkSession, roots: list[str], include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """A dataset's parser that leaves the files where they are; ``preprocess`` cuts them by byte ranges."""
    from .files import scan

    return scan(spark, roots, include, exclude, content=False)


#: Tells ``preprocess`` that files come without their content.
ranges.by_range = True
