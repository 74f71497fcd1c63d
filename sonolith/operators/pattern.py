"""The projection mini-language: ``name``, ``(a, b[0])``, ``{a[:1]->z, b}``; ``:audio``, ``:array``, ``:buffer`` name kinds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("audio", "array", "buffer", "get")
_ITEM = re.compile(r"^(\w+)(?::(\w+))?(?:\[\s*([\d:\s]+?)\s*\])?$")


@dataclass(frozen=True)
class Item:
    name: str
    kind: str
    index: tuple | None
    alias: str | None

    def column(self, rows: DataFrame | None = None) -> Column:
        """By kind: ``audio`` gives doubles (16-bit samples by their scale), ``array`` the values as they are, ``buffer`` their JSON
        as bytes, none the values as they are."""
        x = self._indexed(F.col(self.name))
        kind = rows.schema[self.name].dataType.simpleString() if rows is not None and self.name in rows.columns else ""
        if self.kind == "audio" and "smallint" in kind:
            return decoded(x, kind.count("array") - (self.index is not None and len(self.index) == 1))
        if self.kind == "buffer":
            return F.encode(F.to_json(F.struct(x.alias("value"))), "UTF-8")
        return x

    def _indexed(self, x: Column) -> Column:
        if self.index is None:
            return x
        if len(self.index) == 1:
            return F.get(x, F.lit(self.index[0]))
        start, stop, step = (*self.index, None)[:3]
        n = F.size(x)
        end = n if stop is None else F.least(n, F.lit(stop))
        cut = F.slice(x, F.lit((start or 0) + 1), F.greatest(end - (start or 0), F.lit(0)))
        return cut if step in (None, 1) else F.filter(cut, lambda _, i: i % step == 0)


def decoded(x: Column, depth: int) -> Column:
    """16-bit samples as doubles, in arrays of that depth."""
    return x.cast("double") / F.lit(32767.0) if depth < 1 else F.transform(x, lambda v: decoded(v, depth - 1))


def _item(text: str, named: bool) -> Item:
    body, *alias = (p.strip() for p in text.split("->"))
    if len(alias) > 1 or (alias and not named):
        raise ValueError(f"one -> in an item of a dict only: {text!r}")
    m = _ITEM.match(re.sub(r"\s+(?=[\[:])|(?<=:)\s+", "", body))
    if not m or (m[2] or "get") not in KINDS:
        raise ValueError(f"not an item: {text!r}")
    index = None
    if m[3] is not None:
        parts = [p.strip() for p in m[3].split(":")]
        if len(parts) > 3 or (len(parts) == 1 and not parts[0]) or (len(parts) == 3 and parts[2] == "0"):
            raise ValueError(f"not an index: {text!r}")
        index = tuple(int(p) if p else None for p in parts)
    return Item(m[1], m[2] or "get", index, alias[0] if alias else None)


def parse(pattern: str) -> tuple[str, list[Item]]:
    """Shape (scalar, tuple or dict) and items."""
    text = pattern.strip()
    if text.startswith("{"):
        if not text.endswith("}"):
            raise ValueError(f"unclosed: {pattern!r}")
        return "dict", [_item(p, True) for p in text[1:-1].split(",") if p.strip()]
    bracketed = text.startswith("(")
    if bracketed and not text.endswith(")"):
        raise ValueError(f"unclosed: {pattern!r}")
    inner = text[1:-1] if bracketed else text
    items = [_item(p, False) for p in inner.split(",") if p.strip()]
    if not items:
        raise ValueError(f"no items: {pattern!r}")
    return ("tuple" if bracketed or "," in inner else "scalar"), items


def project(rows: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pattern's columns: a scalar under its name, a tuple as _0, _1 ..., a dict under its aliases."""
    shape, items = parse(pattern)
    name = {"scalar": lambda i, k: i.name, "tuple": lambda i, k: f"_{k}", "dict": lambda i, k: i.alias or i.name}[shape]
    return rows.select(*keep, *(i.column(rows).alias(name(i, k)) for k, i in enumerate(items)))


def transformed(projected: DataFrame, pattern: str, steps) -> DataFrame:
    """Transforms on a projection: by position for a tuple, by name for a dict, the first (or only) one for a scalar. Each maps
    a channel where the column is an array of channels, else the array."""
    shape, items = parse(pattern)
    if not steps:
        return projected
    if shape == "dict":
        if not isinstance(steps, dict):
            raise TypeError("transforms of a dict are given by name")
        chosen = dict(steps)
        if unknown := sorted(set(chosen) - {i.alias or i.name for i in items}):
            raise KeyError(f"no outputs {', '.join(unknown)}")
    elif shape == "tuple":
        chosen = {f"_{k}": f for k, f in enumerate(steps)}
        if len(chosen) > len(items):
            raise ValueError("more transforms than outputs")
    else:
        chosen = {items[0].name: steps if callable(steps) else next(iter(steps))}
    for name, f in chosen.items():
        if f is not None:
            channels = projected.schema[name].dataType.simpleString().startswith("array<array")
            projected = projected.withColumn(name, F.transform(name, f) if channels else f(F.col(name)))
    return projected
