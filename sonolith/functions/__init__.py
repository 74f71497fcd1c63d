"""Column expressions and numpy kernels."""

from . import arrays, dsp, globs, keys, meta, notes, transforms  # noqa: F401
