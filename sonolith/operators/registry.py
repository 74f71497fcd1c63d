"""What can be named in configurations and on the command line: features, transforms, parsers and writers, with users' own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as t
from ..sources import files, signals
from . import events, fragment, signal


@dataclass
class Feature:
    """A feature of fragments: a function of columns, by name.

    value: from the source column (``waveform``'s first channel by default). hashed, hash_from: whether it is indexed, and by what
    function of its value (which alone turns indexing on). pre_chunk: changes the table of whole files before they are cut.
    spec: how to make the feature again, as plain data that is stored beside the rows: a registry entry with its options, or SQL.
    """

    name: str
    value: Callable[[Column], Column]
    source: Callable[[], Column] = lambda: F.element_at("waveform", 1)
    hashed: bool = False
    hash_from: Callable[[Column], Column] | None = None
    pre_chunk: Callable[[DataFrame], DataFrame] | None = None
    metadata: dict = field(default_factory=dict)
    spec: dict | None = None

    def __post_init__(self):
        self.hashed = self.hashed or self.hash_from is not None

    def column(self) -> Column:
        return self.value(self.source())

    def key(self) -> Column:
        return self.hash_from(F.col(self.name)) if self.hash_from else F.col(self.name)


def _pitch_name(hz: Column) -> Column:
    """The name of the most frequent pitch class, the lowest of ties."""
    classes = F.transform(hz, events.pitch_class)
    counted = F.transform(F.array_sort(F.array_distinct(classes)), lambda c: F.struct(F.size(F.filter(classes, lambda v: v == c)).alias("n"), (-c).alias("c")))
    return events.pitch_name(-F.array_max(counted)["c"])


FEATURES: dict[str, Callable[..., Feature]] = {
    "loudness": lambda sr=44100, **o: Feature("loudness", signal.loudness(sr)),
    "mel": lambda sr=44100, n_mels=128, **o: Feature(f"mel_{n_mels}", signal.mel(sr, n_mels=n_mels, **o)),
    "cqt": lambda sr=44100, n_bins=84, **o: Feature(f"cqt_{n_bins}", signal.cqt(sr, n_bins=n_bins, **o)),
    "f0": lambda sr=44100, mode="yin", **o: Feature(f"f0_{mode}", signal.f0(sr, mode, **o)),
    "pitch": lambda sr=44100, mode="yin", **o: Feature("pitch", signal.f0(sr, mode, **o), hash_from=_pitch_name),
    "embedding": lambda sr=44100, width=17, dims=16, stride=16, **o: Feature("embedding", signal.embedding(width, dims, stride)),
}


def module(sr=44100, name="module", weights=(), stride=1, bias=None, model_sr=None, transforms=()) -> Feature:
    """A layer's output of the signal and of each transform of it (by name): the layer is given by its numbers."""
    layer = signal.module([list(w) for w in weights], stride, bias)
    embed = layer if not model_sr or model_sr == sr else lambda x: layer(signal.resample_to(sr, model_sr)(x))
    return Feature(name, lambda x: signal.views(x, embed, [found(TRANSFORMS, t) for t in transforms]))


FEATURES["module"] = module
#: Features that were given as code, by the dataset's folder and their name, for as long as the session lives.
SESSION: dict[tuple[str, str], Feature] = {}


def feature(entry: str, **options) -> Feature:
    """An entry of FEATURES with options; it can be made again from its spec."""
    out = found(FEATURES, entry)(**options)
    out.spec = {"kind": "registry", "entry": entry, "options": options}
    return out


def sql_feature(name: str, expression: str, hash_expression: str | None = None, hashed: bool = False) -> Feature:
    """A feature as SQL over the fragments' columns, and SQL of what it is indexed by."""
    hash_from = (lambda _: F.expr(hash_expression)) if hash_expression else None
    spec = {"kind": "sql", "name": name, "expression": expression, "hash_expression": hash_expression, "hashed": hashed}
    return Feature(name, lambda _: F.expr(expression), hashed=hashed, hash_from=hash_from, spec=spec)


def as_features(given) -> list[Feature]:
    """Features of a list of them, or of a dict of columns or SQL texts by name."""
    if isinstance(given, dict):
        return [sql_feature(n, c) if isinstance(c, str) else Feature(n, lambda _, c=c: c) for n, c in given.items()]
    return list(given or ())


def stored_spec(folder: str, made: Feature) -> dict:
    """What is stored of a feature. One given as code is only known to this session, by the dataset's folder."""
    if made.spec is None:
        SESSION[folder.rstrip("/"), made.name] = made
    return {"name": made.name, "hashed": made.hashed, **(made.spec or {"kind": "session"}), "name": made.name}


def rebuilt(folder: str, spec: dict) -> Feature:
    """A stored feature, ready to be computed for new rows."""
    if spec["kind"] == "registry":
        return feature(spec["entry"], **spec["options"])
    if spec["kind"] == "sql":
        return sql_feature(spec["name"], spec["expression"], spec["hash_expression"], spec["hashed"])
    known = SESSION.get((folder.rstrip("/"), spec["name"]))
    if known is None:
        raise KeyError(f"feature {spec['name']} was given as code, which is not stored: give it again in features, or name it in without")
    return known


TRANSFORMS: dict[str, Callable] = {n: getattr(t, n) for n in ("gain", "gain_plain", "normalise", "pre_emphasis", "derivative", "reverse", "crop", "clip", "clip_share", "tanh", "polarity", "mute", "time_mask", "shift", "delay", "random_delay", "bitcrush", "aliasing", "gain_transition", "repeat_part", "adjust_duration", "add_noise", "dequantise_noise", "short_noises", "mixed")}
TRANSFORMS |= {n: getattr(signal, n) for n in ("filtered", "equaliser", "seven_bands", "resample", "resample_to", "stretch", "random_stretch", "phase_mangle", "random_eq", "random_distort", "random_mask", "random_compress", "time_stretch", "pitch_shift", "air_absorption", "mask_frequencies", "compress", "convolve", "match_loudness", "add_coloured_noise", "integrator")}
#: What finds source files, (spark, roots, include, exclude) to rows as ``files.scan`` gives them ("ranges": long files are cut where
#: they lie, by many tasks each); file formats of tables.
PARSERS: dict[str, Callable[..., DataFrame]] = {"files": files.scan, "ranges": signals.ranges}
WRITERS: dict[str, str] = {"parquet": "parquet", "orc": "orc"}


def parser_name(parser: str | Callable[..., DataFrame] | None) -> str:
    """A parser's name; one given as code is entered under its own for this session."""
    if callable(parser):
        PARSERS[parser.__name__] = parser
        return parser.__name__
    return parser or "files"


CONFIGS = fragment.PRESETS


def found(kind: dict, name: str):
    """An entry by name; an unknown name is an error that tells the known ones."""
    if name not in kind:
        raise KeyError(f"no {name!r}; known: {', '.join(sorted(kind))}")
    return kind[name]
