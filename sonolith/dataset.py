"""Building, updating and reading a dataset folder: fragments, feature index, splits and metadata as tables.

``preprocess`` builds, ``update`` appends files and fills in features, ``add_embedding`` adds one feature with its
views, ``Dataset`` reads. Nothing that is stored is code: rows are columns, indexes are tables, features are names with options or SQL.
Fragments and their index change together, by snapshots (``store.Store``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, globs
from .functions.keys import key_order, ordered_rank
from .operators import fragment, incremental, index, pattern, registry, splits
from .sources import files, signals
from .store import Change, Store


class Dataset:
    """A lazy view of a folder's fragments; queries give DataFrames.

    transforms: one for a scalar pattern (or a list of which the first counts), a list by position for a tuple, a dict by
    name for a dict; without a pattern all of a list go to the waveform, one after the other. Each maps a channel.
    convert: changes what ``read`` gives, at its end. cache: keeps the rows in the executors' memory and disks once they are read.
    """

    def __init__(self, spark: SparkSession, path: str, output_pattern: str | None = None, required: list[str] = (), transforms=(), channels: int | None = None, max_samples: int | None = None, keys: DataFrame | None = None, version: int | None = None, convert: Callable[[DataFrame], DataFrame] | None = None, cache: bool = False):
        self.spark, self.path, self.pattern, self.transforms, self.channels = spark, path, output_pattern, transforms, channels
        self.convert = convert or (lambda rows: rows)
        self.store = Store(spark, path)
        self.snapshot = self.store.snapshot(version)
        rows = index.required(self.store.read("fragments", self.snapshot), list(required))
        rows = rows if keys is None else rows.join(keys.select("frag_key").distinct(), "frag_key", "left_semi")
        rows = rows if max_samples is None else rows.orderBy(key_order(F.col("frag_key"))).limit(max_samples)
        self.rows = rows.persist() if cache else rows
        self.partition_of: Dataset | None = None

    @property
    def index(self) -> DataFrame:
        own = self.store.read("feature_index", self.snapshot)
        return own.join(self.rows.select(F.col("frag_key").alias("key")), "key", "left_semi")

    feature_hash = index

    @property
    def metadata(self) -> dict:
        return dict(self.snapshot["meta"])

    @property
    def version(self) -> int:
        return self.snapshot["version"]

    @property
    def features(self) -> list[str]:
        return self.metadata["features"]

    @property
    def keys(self) -> DataFrame:
        return self.rows.select("frag_key").orderBy(key_order(F.col("frag_key")))

    def __len__(self) -> int:
        return self.rows.count()

    def __contains__(self, key: str) -> bool:
        return not self.rows.where(F.col("frag_key") == key).isEmpty()

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (frag_key) that are stored."""
        return keys.join(self.rows.select("frag_key"), "frag_key", "left_semi")

    def scan(self, low: str | None = None, high: str | None = None, **options) -> DataFrame:
        """Rows in key order, from a key on and below another."""
        rows, key = self.rows, F.col("frag_key")
        # plain comparisons reach the files' statistics where keys are as long as the bound; others are told apart by their length
        at_least = lambda k: (F.length(key) > len(k)) | ((F.length(key) == len(k)) & (key >= k))
        rows = rows if low is None else rows.where(at_least(low))
        rows = rows if high is None else rows.where(~at_least(high))
        return self.read(rows, **options).orderBy(key_order(F.col("frag_key")))

    def has_split(self, name: str = "partitions") -> bool:
        return splits.has_split(self.spark, f"{self.path}/splits", name)

    def get(self, key: str, output_pattern: str | None = None, transforms: list | None = None) -> DataFrame:
        """One row by key; what is given here goes before the dataset's own."""
        return self.read(self.rows.where(F.col("frag_key") == key), output_pattern, transforms)

    def at(self, position: int, **options) -> DataFrame:
        """By position in key order: keys are ranked within ranges, so that none but the one found reaches one place."""
        numbers = self.rows.select("frag_key", F.col("frag_key").cast("long").alias("_number"))
        keys = ordered_rank(numbers, "_number", "_position").where(F.col("_position") == position).select("frag_key")
        return self.read(self.rows.join(F.broadcast(keys), "frag_key", "left_semi"), **options)  # one key

    def read(self, rows: DataFrame | None = None, output_pattern: str | None = None, transforms=None) -> DataFrame:
        """The pattern's columns, changed by the transforms; what is given here goes before the dataset's own."""
        rows = self.rows if rows is None else rows
        if self.channels:
            rows = rows.withColumn("waveform", arrays.fix_channels(F.col("waveform"), self.channels))
        steps = self.transforms if transforms is None else transforms
        chosen = output_pattern or self.pattern
        if chosen:
            return self.convert(pattern.transformed(pattern.project(rows, chosen, keep=("frag_key",)), chosen, steps))
        for t in [steps] if callable(steps) else steps:
            rows = rows.withColumn("waveform", F.transform("waveform", t))
        return self.convert(rows)

    def query(self, n: int | None = None, seed: int | None = None, **wanted) -> DataFrame:
        """Rows with one of the given values of every feature: all, the first n by key, or n draws with replacement by seed."""
        lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in wanted.items()}
        index.require_values(self.index, lists)
        keys = index.lookup(self.index, lists)
        if n is not None:
            keys = keys.orderBy(key_order(F.col("key"))).limit(n) if seed is None else index.draw_n(keys, "key", n, seed)
        return keys.select(F.col("key").alias("frag_key")).join(self.rows, "frag_key")

    def split(self, ratios, features: list[str] = (), balance: bool = False, seed: int = 0, name: str | None = None, tolerance: float = 0.1, use_meta: bool = True, load_if_available: bool = False) -> dict[str, Dataset]:
        """Datasets by part: of rows, of whole labels, or of labels balanced by their row counts. With a name it is stored.

        Tried before, in this order: the stored split of that name (``load_if_available``), and a feature called ``partition``
        that names the parts (``use_meta``).
        """
        if load_if_available and self.has_split(name or "partitions"):
            return self.load_split(name or "partitions")
        if self.partition_of is not None:
            raise ValueError("this is already a part of a dataset")
        if use_meta and "partition" in self.rows.columns and not features:
            parts = splits.split_by_feature(self.rows, "partition", list(ratios))
        elif balance:
            parts = splits.split_balanced(self.rows, features[0], ratios, tolerance)
        elif features:
            parts = splits.split_labels(self.rows, list(features), ratios, seed)
        else:
            parts = splits.split_rows(self.rows, "frag_key", ratios, seed)
        if name:
            splits.write_splits(parts, "frag_key", f"{self.path}/splits", name)
        return {p: self.subset(parts.where(F.col("split") == p)) for p in ratios}

    def load_split(self, name: str = "partitions") -> dict[str, Dataset]:
        stored = splits.read_splits(self.spark, f"{self.path}/splits", name)
        return {r.split: self.subset(stored.where(F.col("split") == r.split).select(F.col("key").alias("frag_key"))) for r in stored.select("split").distinct().collect()}

    def subset(self, keys: DataFrame) -> Dataset:
        out = Dataset(self.spark, self.path, self.pattern, transforms=self.transforms, channels=self.channels, version=self.version, convert=self.convert)
        out.rows = self.rows.join(keys.select("frag_key").distinct(), "frag_key", "left_semi")
        out.partition_of = self
        return out


SimpleDataset = Dataset


def _by_range(scanned: DataFrame, windows, sr, channels, hooks) -> DataFrame:
    """Windows cut by many tasks a file. Files at another rate than ``sr`` are an error, as resampling needs them whole."""
    if hooks:
        raise ValueError("hooks see whole files, which the parser ranges never has")
    cut = signals.windows(scanned, windows).where("start is not null")
    if sr:
        cut = cut.withColumn("sr", F.when(F.col("sr") == sr, F.col("sr")).otherwise(F.raise_error(F.concat(F.col("file_path"), F.lit(" has another rate, and the parser ranges does not resample")))))
    if channels:
        cut = cut.withColumn("waveform", arrays.fix_channels(F.col("waveform"), channels))
    return cut.withColumn("file_length", F.col("n_frames") / F.col("sr")).drop("channels", "n_frames", "problem")


def _whole(scanned: DataFrame, windows, sr, channels, hooks) -> DataFrame:
    """Windows of files that are decoded as a whole and changed by the hooks."""
    audio = files.decode(scanned, sr, channels)
    for hook in hooks:
        audio = hook(audio)
    stacked = audio.withColumn("n", F.size(F.element_at("waveform", 1)))
    chunk, hop, least = windows.samples(F.col("sr") if windows.in_seconds() else None)
    size = chunk if isinstance(chunk, Column) else F.lit(chunk)
    rows = stacked.withColumn("start", F.explode(arrays.starts(F.col("n"), chunk, hop, least)))
    return rows.withColumn("waveform", F.transform("waveform", lambda c: F.slice(c, F.col("start") + 1, size))).drop("n", "length", "relative")


def _fragments(scanned: DataFrame, windows, sr, channels, loudness_threshold, hooks=(), by_range: bool = False) -> DataFrame:
    """Windows of scanned files. Lengths in seconds are at the files' own rates, or at the rate that all are brought to."""
    rows = (_by_range if by_range else _whole)(scanned, windows, sr, channels, hooks)
    chunk = windows.samples(F.col("sr") if windows.in_seconds() else None)[0]
    size = chunk if isinstance(chunk, Column) else F.lit(chunk)
    if windows.pad != "discard":
        rows = rows.withColumn("waveform", F.transform("waveform", lambda c: arrays.pad(c, chunk, windows.pad)))
    if loudness_threshold is not None:
        from .operators import signal

        rows = rows.where(signal.loudness_of_channels_at(F.col("waveform"), F.col("sr")) >= loudness_threshold)
    own = ("root", "file_path", "start", "file_length", "sr", "waveform")
    return rows.select("root", "file_path", (F.col("start") / F.col("sr")).alias("start_pos"), (size / F.col("sr")).alias("length"), "file_length", "sr", "waveform", *(c for c in rows.columns if c not in own))


def _columns(features: list[registry.Feature], patterns: list[str]) -> dict[str, Column]:
    """The features' columns by name, those of path patterns first."""
    return {**{n: globs.captured(F.col("file_path"), ps, n) for n, ps in globs.fields(patterns).items()}, **{f.name: f.column() for f in features}}


def _keys(features: list[registry.Feature], named: list[str]) -> dict[str, Column]:
    """What rows are indexed by: features by their own rule, the other names by their values."""
    return {n: F.col(n) for n in named} | {f.name: f.key() for f in features if f.hashed}


def _index_of(rows: DataFrame, hashed: dict[str, Column], path: bool = True) -> DataFrame:
    """Sorted by feature, value and key, in ranges of all three: rows of one value are many tasks' work."""
    found = index.feature_index(rows, ({"original_path": F.col("file_path")} if path else {}) | hashed, "frag_key")
    return found.repartitionByRange("feature", "value", "key").sortWithinPartitions("feature", "value", "key")


def _counted(meta: dict, written: DataFrame) -> dict:
    """The metadata with the rows and seconds of newly written fragments."""
    new = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("s")).first()
    return meta | {"n_chunks": meta.get("n_chunks", 0) + new.n, "n_seconds": meta.get("n_seconds", 0.0) + new.s}


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    return incremental.numbered(rows, first, ["start_pos"], "file_path")


def preprocess(spark: SparkSession, roots: list[str], out: str, windows: fragment.Windows, sr: int | None = None, channels: int | None = None, include: list[str] = (), exclude: list[str] = (), loudness_threshold: float | None = None, features=None, patterns: list[str] = (), hashed: list[str] = (), waveform: bool = True, force: bool = False, dir_parser: str | Callable[..., DataFrame] | None = None, writer: str = "parquet", config: dict | None = None) -> Dataset:
    """Build a dataset. An existing one is an error, or is replaced with ``force`` (its snapshots stay until ``vacuum``).

    features: columns or SQL by name, or ``registry.Feature`` objects. dir_parser: scans in place of ``sources.files.scan``, by its
    name in ``registry.PARSERS`` or as code. writer: the tables' file format, by its name in ``registry.WRITERS``. config: the resolved
    configuration (``operators.config``) that the other arguments come from; it is kept in the metadata.
    """
    change = Store(spark, out).change("preprocess")
    if change.base["version"] and not force:
        raise FileExistsError(f"there is a dataset in {out}")
    made, parser = registry.as_features(features), registry.parser_name(dir_parser)
    parse = registry.found(registry.PARSERS, parser)
    scanned, by_range = parse(spark, list(roots), include, exclude), getattr(parse, "by_range", False)
    cut = _fragments(scanned, windows, sr, channels, loudness_threshold, [f.pre_chunk for f in made if f.pre_chunk], by_range)
    columns, format_ = _columns(made, list(patterns)), registry.found(registry.WRITERS, writer)
    named = sorted({*hashed, *globs.fields(list(patterns))})
    rows = _numbered(incremental.backfill(cut, columns), 0)
    stored = change.replace("fragments", rows if waveform else rows.drop("waveform"), format_)
    change.replace("feature_index", _index_of(stored, _keys(made, named)), format_)
    change.replace("skipped", signals.problems(scanned), format_)
    meta = {"features": list(columns), "specs": [registry.stored_spec(out, f) for f in made], "hashed": sorted({*named, *(f.name for f in made if f.hashed)}), "windows": asdict(windows), "sr": sr, "channels": channels, "include": list(include), "exclude": list(exclude), "patterns": list(patterns), "loudness_threshold": loudness_threshold, "waveform": waveform, "writer": writer, "parser": parser, "next": change.rows("fragments"), "n_skipped": change.rows("skipped"), "config": config}
    change.commit(_counted(meta, stored))
    return Dataset(spark, out)


def update(spark: SparkSession, path: str, roots: list[str] = (), features=None, hashed: list[str] = (), overwrite: bool = False, include: list[str] | None = None, exclude: list[str] | None = None, patterns: list[str] = (), dir_parser: str | Callable[..., DataFrame] | None = None, without: list[str] = (), scanned: DataFrame | None = None) -> Dataset:
    """Append files that are not stored yet, with the build's own options, and fill in features.

    New rows get every feature that the dataset has, made again from what is stored of it, with its hooks and its keys of the index; one that
    was given as code in another session is an error, unless it is given again or named in ``without`` (then it is null).
    scanned: rows as ``files.scan`` gives them, in place of roots.
    Stored files are left out before any is decoded. Without new features the new rows and their index entries are appended and
    nothing stored is written again; with some, the rows are written once more, and of the index what belongs to features that are computed anew.
    """
    old = Dataset(spark, path)
    meta, stored, change = old.metadata, old.rows, old.store.change("update")
    given = registry.as_features(features)
    names = {f.name for f in given}
    extra = [p for p in patterns if p not in meta["patterns"]]
    before = {n for n in meta["hashed"] if n not in names}
    fresh = None
    if roots or scanned is not None:
        known = [registry.rebuilt(path, s) for s in meta["specs"] if s["name"] not in names and s["name"] not in without]
        parse = registry.found(registry.PARSERS, registry.parser_name(dir_parser or meta["parser"]))
        if scanned is None:
            scanned = parse(spark, list(roots), meta["include"] if include is None else include, meta["exclude"] if exclude is None else exclude)
        scanned = incremental.new_files(scanned, stored, "file_path")
        cut = _fragments(scanned, fragment.Windows(**meta["windows"]), meta["sr"], meta["channels"], meta["loudness_threshold"], [f.pre_chunk for f in (*known, *given) if f.pre_chunk], getattr(parse, "by_range", False))
        fresh = _numbered(incremental.backfill(cut, _columns([*known, *given], [*meta["patterns"], *extra])), meta["next"])
        fresh = fresh if meta["waveform"] else fresh.drop("waveform")
        rules = _keys([*known, *given], sorted({*before, *hashed, *globs.fields(extra)} - {f.name for f in known if f.hashed} - set(without)))
    columns = _columns(given, extra)
    anew = sorted({n for n in {*names, *globs.fields(extra)} if overwrite or n not in meta["features"]} | ({*hashed} - before) | {f.name for f in given if f.hashed})
    held = change.tables["fragments"]
    if columns:
        written = change.replace("fragments", incremental.backfill(stored, columns, overwrite))
        own = {n: c for n, c in _keys(given, sorted({*hashed, *globs.fields(extra)} - {f.name for f in given if f.hashed})).items() if n in anew}
        _reindex(change, written, own, stale=[n for n in own if n in meta["hashed"]])
    elif anew:
        _reindex(change, old.store.read("fragments", old.snapshot), {n: F.col(n) for n in anew}, [])
    added = None
    if fresh is not None:
        added = change.append("fragments", fresh)
        meta["next"] += change.rows("fragments") - sum(p["rows"] for p in held["parts"])
        if not added.isEmpty():
            change.append("feature_index", _index_of(added, rules))
            meta = _counted(meta, added)
            told = old.store.read("skipped", old.snapshot)
            change.append("skipped", signals.problems(scanned.join(told, "file_path", "left_anti")))
            meta["n_skipped"] = change.rows("skipped")
    if change.tables["fragments"]["parts"] == held["parts"] and not anew:
        return old
    meta["features"] = list(dict.fromkeys([*meta["features"], *columns]))
    meta["specs"] = [s for s in meta["specs"] if s["name"] not in names] + [registry.stored_spec(path, f) for f in given]
    meta["hashed"] = sorted({*meta["hashed"], *hashed, *globs.fields(extra), *(f.name for f in given if f.hashed)})
    meta["patterns"] = [*meta["patterns"], *extra]
    change.commit(meta)
    return Dataset(spark, path)


def _reindex(change: Change, rows: DataFrame, keys: dict[str, Column], stale: list[str]) -> None:
    """Index entries by these features for all stored rows; the stale ones' old entries go."""
    if not keys:
        return
    new = _index_of(rows, keys, path=False)
    if stale:
        change.replace("feature_index", change.store.read("feature_index", change.base).where(~F.col("feature").isin(stale)))
    change.append("feature_index", new)


def compact(spark: SparkSession, path: str, rows_a_file: int = 100_000) -> Dataset:
    """The many files of appends as few ones, in key order; the rows stay as they are. Old files stay until ``vacuum``."""
    old = Dataset(spark, path)
    change = old.store.change("compact")
    order = [F.length("frag_key"), F.col("frag_key")]
    stored = old.store.read("fragments", change.base)
    change.replace("fragments", stored.repartitionByRange(max(1, -(-change.rows("fragments") // rows_a_file)), *order).sortWithinPartitions(*order))
    entries = old.store.read("feature_index", change.base)
    change.replace("feature_index", entries.repartitionByRange("feature", "value", "key").sortWithinPartitions("feature", "value", "key"))
    for table in ("fragments", "feature_index"):
        before = sum(p["rows"] for p in change.base["tables"][table]["parts"])
        if change.rows(table) != before:
            raise RuntimeError(f"{table} has {before} rows and {change.rows(table)} were written; nothing is changed")
    change.commit(old.metadata)
    return Dataset(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes snapshots but the last ``keep`` and the files that only older ones name."""
    return Store(spark, path).vacuum(keep)


def add_embedding(spark: SparkSession, path: str, name: str, embed: Callable[[Column], Column], transforms: list[Callable[[Column], Column]] = (), overwrite: bool = True) -> Dataset:
    """Adds the embedding of the first channel and of each transform of it: 1 + n views."""
    from .operators.signal import views

    return update(spark, path, features=[registry.Feature(name, lambda x: views(x, embed, list(transforms)))], overwrite=overwrite)


def info(dataset: Dataset, check: list[str] = ()) -> dict[str, DataFrame]:
    """files, files that were skipped and why, columns, shapes and, of the features named, what is missing."""
    out = {"files": index.files(dataset.rows, "file_path"), "skipped": dataset.store.read("skipped", dataset.snapshot), "columns": index.describe(dataset.rows), "shapes": index.shapes(dataset.rows, "frag_key")}
    return out | ({"missing": index.missing(dataset.rows, list(check), "frag_key")} if check else {})
