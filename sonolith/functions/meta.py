"""Metadata of rows: maps of strings, kept as a column and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "map<string,string>"


def parsed(text: Column) -> Column:
    """The fields of a JSON object as strings; an empty map where it is none."""
    return F.coalesce(F.from_json(text, KIND), F.create_map().cast(KIND))


def written(meta: Column) -> Column:
    """The map as a JSON object, its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta))))


def get(meta: Column, key: str) -> Column:
    return F.element_at(meta, key)


def put(meta: Column, **values) -> Column:
    """With these fields, new or in place of old ones; the others stay."""
    return F.map_concat(drop(meta, *values), F.create_map(*(x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")))).cast(KIND)) if values else meta


def drop(meta: Column, *keys: str) -> Column:
    return F.map_filter(meta, lambda k, _: ~k.isin(list(keys))) if keys else meta


def only(**values) -> Column:
    """These fields in place of all others."""
    return put(F.create_map().cast(KIND), **values)


def attributes(rows: DataFrame, names: list[str], column: str = "metadata") -> DataFrame:
    """Fields of the rows' metadata as columns of their own; one that a row lacks is null. A name that is a column already is an error."""
    if taken := [n for n in names if n in rows.columns]:
        raise ValueError(f"columns already: {', '.join(taken)}")
    return rows.select("*", *(get(F.col(column), n).alias(n) for n in names))


def collected(rows: DataFrame, names: list[str], column: str = "metadata") -> DataFrame:
    """Columns back into the rows' metadata: what is not null is put there, what is null is taken out; the columns go."""
    base = F.coalesce(drop(F.col(column), *names), F.create_map().cast(KIND)) if column in rows.columns else F.create_map().cast(KIND)
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names))
    own = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.withColumn(column, F.map_concat(base, own)).drop(*names)


def tag(key: Column, seed: int = 0) -> Column:
    """Eight letters from a to y, from the hash of a key."""
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    letter = lambda k: F.char((F.lit(97) + F.conv(F.substring(digits, 4 * k + 1, 4), 16, 10).cast("int") % 25).cast("int"))
    return F.concat(*(letter(k) for k in range(8)))
