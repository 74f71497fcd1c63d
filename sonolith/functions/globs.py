"""Two dialects of path patterns, as regular expressions for ``rlike`` and ``regexp_extract``.

File filters: ``*`` and ``?`` also match ``/``. Feature patterns: ``**/`` is at least one
directory, ``*`` stays within a name, ``{{name}}`` captures word characters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The audio files that are scanned, by extension.
AUDIO_EXTENSIONS = ("mp3", "wav", "aif", "aiff", "flac", "opus")


def file_regex(pattern: str) -> str:
    """Anchored; ``[!x]`` negates; an unclosed ``[`` is itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif end > 0:
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", pattern[i + 1 : end])
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/ " else c)
        i += 1
    return "^" + "".join(out) + "$"


def any_of(path: Column, patterns: list[str]) -> Column:
    """Include filter: one of the patterns fits; no patterns let everything through."""
    return reduce(lambda a, b: a | b, (path.rlike(file_regex(p)) for p in patterns)) if patterns else F.lit(True)


def none_of(path: Column, patterns: list[str]) -> Column:
    """Exclude filter: none of the patterns fits."""
    return reduce(lambda a, b: a & b, (~path.rlike(file_regex(p)) for p in patterns)) if patterns else F.lit(True)


def extension_regex(extensions=AUDIO_EXTENSIONS) -> str:
    forms = "|".join([*extensions, *(e.upper() for e in extensions)])
    return f"\\.({forms})$"


def has_extension(path: Column, extensions=AUDIO_EXTENSIONS) -> Column:
    """All lower or all upper case; a mixed one does not count."""
    return path.rlike(extension_regex(extensions))


_FIELD = re.compile(r"\{\{(\w+)\}\}")


def fields(patterns: list[str]) -> dict[str, list[str]]:
    """The placeholders of the patterns, each with the patterns that mention it."""
    found: dict[str, list[str]] = {}
    for p in patterns:
        for name in dict.fromkeys(_FIELD.findall(p)):
            found.setdefault(name, []).append(p)
    return found


def feature_regex(pattern: str, name: str) -> str:
    """The pattern with ``{{name}}`` as its one group; directories may stand in front of it."""
    out = []
    for part in re.split(r"(\{\{\w+\}\}|\*\*/|\*)", pattern):
        if part == "**/":
            out.append("(?:.*/)")
        elif part == "*":
            out.append("[^/]*")
        elif m := _FIELD.fullmatch(part):
            out.append("(\\w+)?" if m[1] == name else "\\w*?")
        else:
            out.append(re.escape(part).replace("\\/", "/"))
    return "^(?:.*/)?" + "".join(out) + "$"


def captured(path: Column, patterns: list[str], name: str) -> Column:
    """The first pattern's capture that is not empty, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(path, feature_regex(p, name), 1), F.lit("")) for p in patterns))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def relative_to_parent(path: Column, root: str) -> Column:
    """The path from the root's own folder name on."""
    clean = root.rstrip("/")
    parent = clean.rsplit("/", 1)[0] + "/" if "/" in clean else ""
    return F.when(path.startswith(parent), F.substring(path, F.lit(len(parent) + 1), F.length(path))).otherwise(path)
