"""Appending files that are not stored yet, and filling in features of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import frag_key, key_order


def new_files(incoming: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """Rows of files that are not stored."""
    return incoming.join(stored.select(path).distinct(), path, "left_anti")


def numbered(rows: DataFrame, first: int, order: list[str], by: str) -> DataFrame:
    """Adds frag_key, from ``first`` on, file by file: ranks within files, with the files' sizes summed up before."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n")).withColumn("_b", F.substring(F.md5(F.col(by)), 1, 2))
    buckets = sizes.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_low"))
    before = sizes.join(F.broadcast(buckets), "_b").select(by, (F.col("_low") + F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    local = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return local.join(before, by).withColumn("frag_key", frag_key(F.col("_before") + F.col("_k") + F.lit(first))).drop("_before", "_k")


def next_number(stored: DataFrame) -> int:
    top = stored.agg(F.max(key_order(F.col("frag_key"))).alias("k")).first()[0]
    return 0 if top is None else int(top[1]) + 1


def append(stored: DataFrame, incoming: DataFrame, path: str, order: list[str]) -> DataFrame:
    """The new files' rows with keys that go on after the stored ones."""
    return numbered(new_files(incoming, stored, path), next_number(stored), order, path)


def backfill(rows: DataFrame, features: dict[str, Column], overwrite: bool = False) -> DataFrame:
    """Features that are not there are added; those that are stay, row by row, unless overwritten."""
    for name, value in features.items():
        rows = rows.withColumn(name, value if overwrite or name not in rows.columns else F.coalesce(F.col(name), value))
    return rows
