"""Layered configurations: files that include others, found on search paths, with scopes and overrides.

A file is a JSON (or YAML) object. ``include`` names files that come before it, ``scopes`` holds objects that come after it where that
scope is asked for. Objects are merged key by key, everything else is replaced; the last one wins: includes in order, the file, its
scopes in the order asked for, overrides. ``resolve`` gives plain data, which is stored beside a dataset as what it was built with.
"""

from __future__ import annotations

import dataclasses
import json
import os

from . import fragment

#: What a configuration may say, by section; ``features`` is a list of registry entries with options.
SECTIONS = {"windows": {f.name for f in dataclasses.fields(fragment.Windows)}, "audio": {"sr", "channels", "loudness_threshold", "waveform"}, "files": {"include", "exclude", "patterns", "parser", "writer"}, "features": None, "hashed": None}


def _built_in() -> dict[str, dict]:
    """Configurations that every file can include by name: the presets, and one for each feature that is shipped on its own."""
    out = {n: {"windows": dataclasses.asdict(w)} for n, w in fragment.PRESETS.items()}
    for n, level in fragment.PRESET_LOUDNESS.items():
        out[n]["audio"] = {"loudness_threshold": level}
    return out | {n: {"features": [{"entry": n}]} for n in ("mel", "loudness")}


BUILT_IN = _built_in()


def read(path: str) -> dict:
    """A file's object, in JSON or, where that library is there, in YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)


def find(name: str, search: list[str], beside: str | None = None) -> str:
    """A file by its path, beside the one that includes it, or on the search paths in order; ``.json`` may be left out."""
    folders = ([beside] if beside else []) + ([""] if beside is None or os.path.isabs(name) else []) + list(search)
    for folder in folders:
        for ending in ("", ".json", ".yaml"):
            path = os.path.join(folder, name + ending)
            if os.path.isfile(path):
                return os.path.abspath(path)
    raise FileNotFoundError(f"no configuration {name} in {', '.join(f or '.' for f in folders)}")


def merge(low: dict, high: dict) -> dict:
    out = dict(low)
    for k, v in high.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _layers(path: str, search: list[str], scopes: list[str], within: tuple[str, ...]) -> tuple[dict, set[str]]:
    if path in within:
        raise ValueError(f"{' includes '.join([*within, path])}")
    own = read(path)
    if not isinstance(own, dict):
        raise ValueError(f"{path} is no object")
    out, known = {}, set()
    names = own.pop("include", [])
    for name in [names] if isinstance(names, str) else names:
        below, seen = (BUILT_IN[name], set()) if name in BUILT_IN else _layers(find(name, search, os.path.dirname(path)), search, scopes, (*within, path))
        out, known = merge(out, below), known | seen
    scoped = own.pop("scopes", {})
    out = merge(out, own)
    for scope in scopes:
        out = merge(out, scoped.get(scope, {}))
    return out, known | set(scoped)


def override(text: str) -> dict:
    """``section.key=value`` as an object; the value is JSON, or else a string."""
    name, sign, value = text.partition("=")
    if not sign:
        raise ValueError(f"{text}: say section.key=value")
    try:
        out = json.loads(value)
    except json.JSONDecodeError:
        out = value
    for key in reversed(name.split(".")):
        out = {key: out}
    return out


def resolve(name: str | None, search: list[str] = (), scopes: list[str] = (), overrides: list[str] = ()) -> dict:
    """What a configuration says in the end; it is a file or one that is built in. Unknown sections, keys and scopes are errors."""
    out, known = dict(BUILT_IN.get(name, {})), set()
    if name is not None and name not in BUILT_IN:
        out, known = _layers(find(name, list(search)), list(search), list(scopes), ())
    if missing := [s for s in scopes if s not in known]:
        raise KeyError(f"no scope {', '.join(missing)}; known: {', '.join(sorted(known))}")
    for text in overrides:
        out = merge(out, override(text))
    for section, value in out.items():
        if section not in SECTIONS:
            raise KeyError(f"no section {section}; known: {', '.join(SECTIONS)}")
        keys = SECTIONS[section]
        if keys is not None and (bad := sorted(set(value) - keys)):
            raise KeyError(f"no {section}.{bad[0]}; known: {', '.join(sorted(keys))}")
    return out


def arguments(config: dict) -> dict:
    """A resolved configuration as arguments of ``dataset.preprocess``, itself among them."""
    from . import registry

    files, audio = config.get("files", {}), config.get("audio", {})
    sr = audio.get("sr")
    made = []
    for entry in config.get("features", []):
        named = {"entry": entry} if isinstance(entry, str) else dict(entry)
        made.append(registry.feature(named.pop("entry"), **({"sr": sr} if sr else {}), **named))
    windows = fragment.Windows(**{"chunk": fragment.PRESETS["default"].chunk, **config.get("windows", {}), **({"sr": sr} if sr else {})})
    renamed = {"parser": "dir_parser"}
    return {"windows": windows, "features": made, "hashed": config.get("hashed", []), "config": config, **audio, **{renamed.get(k, k): v for k, v in files.items()}}
