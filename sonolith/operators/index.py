"""The inverted index (feature, value, key), lookups in it, and reports on a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ordered_rank, shuffle_hash


def feature_index(rows: DataFrame, features: dict[str, Column], key: str) -> DataFrame:
    """feature, value, key: one row for each value that is not null. Long form, so no value's keys meet in one row."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("string").alias("value")) for n, c in features.items()))
    return rows.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).where("p.value is not null").select("p.feature", "p.value", "key")


def value_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("feature", "value").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def lookup(index: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Keys that have one of the values of every feature: OR within a feature, AND across them."""
    if not wanted:
        return index.select("key").distinct()
    hit = reduce(lambda a, b: a | b, ((F.col("feature") == n) & F.col("value").isin([str(v) for v in values]) for n, values in wanted.items()))
    return index.where(hit).groupBy("key").agg(F.count_distinct("feature").alias("n")).where(F.col("n") == len(wanted)).select("key")


def require_values(index: DataFrame, wanted: dict[str, list]) -> None:
    """A clear error for values that no row has."""
    for name, values in wanted.items():
        known = {r.value for r in index.where((F.col("feature") == name) & F.col("value").isin([str(v) for v in values])).select("value").distinct().collect()}
        if missing := sorted({str(v) for v in values} - known):
            raise KeyError(f"feature {name} has no value {', '.join(missing)}")


def first_n(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first n keys of each group. Spark keeps n rows a group and partition before it shuffles them."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("rn") <= n)


def sample_n(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from each group: draw i takes the key whose place in the group's order is hash(seed, group, i) mod size."""
    numbered = ordered_rank(rows.select(group, key), key, "place", group)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("place", F.conv(F.substring(shuffle_hash(F.concat_ws("/", F.col(group), F.col("draw")), seed), 1, 8), 16, 10).cast("long") % F.col("n")).drop("n")
    return draws.join(numbered, [group, "place"]).select(group, "draw", key)


def draw_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from all rows: draw, key."""
    from .combine import epoch

    return epoch(rows, key, n, seed, replace=True)


def required(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have all the features; an unknown name is an error."""
    if unknown := [n for n in names if n not in rows.columns]:
        raise KeyError(f"no such features: {', '.join(unknown)}")
    return rows.dropna(subset=names) if names else rows


def status(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, present, missing."""
    counted = rows.agg(F.count("*").alias("_all"), *(F.count(n).alias(n) for n in names))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("present"), (F.col("_all") - F.col(n)).alias("missing")) for n in names))).alias("s")).select("s.*")


def bitmap(rows: DataFrame, name: str, position: str) -> DataFrame:
    """The feature's presence over positions, as bitmaps of buckets."""
    present = rows.where(F.col(name).isNotNull())
    return present.groupBy(F.call_function("bitmap_bucket_number", F.col(position)).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col(position))).alias("bits")).withColumn("present", F.call_function("bitmap_count", F.col("bits")))


def files(rows: DataFrame, path: str) -> DataFrame:
    return rows.groupBy(path).agg(F.count("*").alias("n_chunks"))


def missing(rows: DataFrame, names: list[str], key: str) -> DataFrame:
    """key, feature: what each row lacks."""
    lacks = F.filter(F.array(*(F.when(F.col(n).isNull(), n) for n in names)), lambda v: v.isNotNull())
    return rows.select(key, F.explode(lacks).alias("feature"))


def describe(rows: DataFrame) -> DataFrame:
    """column, type: the layout of a dataset."""
    return rows.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in rows.schema], "column string, type string")


def shapes(rows: DataFrame, key: str, rate: str | None = "sr") -> DataFrame:
    """key, column, shape, sr: of every array column its sizes along the first and the second axis, and the row's rate."""
    arrays = [f.name for f in rows.schema if f.dataType.typeName() == "array"]
    nested = {f.name for f in rows.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "array"}
    of = lambda c: F.when(F.col(c).isNotNull(), F.array(F.size(c), F.size(F.get(c, F.lit(0)))) if c in nested else F.array(F.size(c)))
    listed = F.array(*(F.struct(F.lit(c).alias("column"), of(c).alias("shape")) for c in arrays))
    own = F.col(rate).cast("int") if rate in rows.columns else F.lit(None).cast("int")
    return rows.select(key, own.alias("sr"), F.explode(listed).alias("s")).where("s.shape is not null").select(key, "s.column", "s.shape", "sr")
