"""Row keys and reproducible random orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 9


def frag_key(number: Column) -> Column:
    """Zero-padded, so that byte order is number order; from 10^9 on keys are longer (``key_order`` keeps their order)."""
    text = number.cast("string")
    return F.when(F.length(text) <= WIDTH, F.lpad(text, WIDTH, "0")).otherwise(text)


def key_order(key: Column) -> Column:
    """Sorts keys of any length by their numbers."""
    return F.struct(F.length(key), key)


def shuffle_hash(key: Column, seed: int | str) -> Column:
    """A hash by which rows stand in random order: the same for the same seed on any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def uniform(key: Column, seed: int | str) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of the hash."""
    return F.conv(F.substring(shuffle_hash(key, seed), 1, 13), 16, 10).cast("double") / float(16**13)


def global_rank(df: DataFrame, order: Column, tie: Column, name: str = "rank", digits: int = 4) -> DataFrame:
    """0-based rank in the order of a hexadecimal hash, without sorting all rows in one task.

    Rows are ranked within buckets of the hash's first digits; bucket sizes (at most 16**digits) are summed up and added.
    """
    bucketed = df.withColumn("_o", order).withColumn("_t", tie).withColumn("_b", F.substring("_o", 1, digits))
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_o", "_t")) - 1
    return bucketed.withColumn("_k", inside).join(F.broadcast(before), "_b").withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_o", "_t", "_b", "_k", "_before")


#: Keys that are sampled to cut an order into ranges, and the ranges.
SAMPLED, RANGES = 20_000, 1_000


def ordered_rank(df: DataFrame, key: str, name: str = "rank", by: str | None = None) -> DataFrame:
    """0-based rank in the order of a key (within ``by``; equal keys stand in the order of their rows' hash), without sorting all rows in one task.

    A sample of keys by hash (SAMPLED at most, on the driver) cuts the order into RANGES; rows are ranked within ranges and the
    ranges' sizes are added up. With ``by`` there are RANGES for each group, so whether their sizes are broadcast is left to Spark.
    """
    sample = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLED).collect())
    bounds = [sample[k] for k in range(0, len(sample), max(1, len(sample) // RANGES))][1:]
    tie = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))
    known = df.sparkSession.createDataFrame([(bounds,)], f"_rank_bounds array<{df.schema[key].dataType.simpleString()}>") if bounds else None
    if known is None:
        ranged = df.withColumn("_rank_r", F.lit(0))
    else:
        halved = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.col(key) < F.get("_rank_bounds", F.shiftright(s["lo"] + s["hi"], 1)), F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi"))).otherwise(F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi")))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halved, lambda s: s["lo"])
        ranged = df.join(F.broadcast(known)).withColumn("_rank_r", F.when(F.col(key).isNull(), -1).otherwise(place)).drop("_rank_bounds")
    group = [by] if by else []
    sizes = ranged.groupBy(*group, "_rank_r").agg(F.count("*").alias("_rank_n"))
    order = Window.partitionBy(*group).orderBy("_rank_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(order), F.lit(0))).drop("_rank_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_rank_r").orderBy(F.col(key).asc_nulls_first(), tie)) - 1
    return ranged.withColumn("_rank_k", inside).join(before if by else F.broadcast(before), [*group, "_rank_r"]).withColumn(name, (F.col("_rank_before") + F.col("_rank_k")).cast("long")).drop("_rank_r", "_rank_k", "_rank_before")
