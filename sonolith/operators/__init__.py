"""Operators on DataFrames."""

from . import beats, cluster, combine, events, fragment, incremental, index, notes, pattern, registry, signal, splits  # noqa: F401
from .registry import FEATURES, TRANSFORMS, Feature  # noqa: F401
