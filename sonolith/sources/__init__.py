"""Files in and out."""

from . import files  # noqa: F401
