"""Several datasets as one, positions in it, weighted samples and balanced batches."""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import global_rank, ordered_rank, shuffle_hash, uniform
from ..store import work_dir


def concatenate(parts: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """The parts one after the other, with ds_id and weight; their schemas must be the same."""
    first = [(f.name, f.dataType) for f in parts[0].schema]
    for k, p in enumerate(parts):
        if [(f.name, f.dataType) for f in p.schema] != first:
            raise ValueError(f"dataset {k} has another schema than the first")
    out = None
    for k, p in enumerate(parts):
        one = p.withColumn("ds_id", F.lit(k)).withColumn("weight", F.lit(float(weights[k] if weights else 1.0)))
        out = one if out is None else out.unionByName(one)
    return out


def positions(combined: DataFrame, key: str) -> DataFrame:
    """Adds position: rows in the order of dataset and key. Ranked within each dataset by ranges of keys; sizes are added up over datasets."""
    sizes = combined.groupBy("ds_id").agg(F.count("*").alias("_n"))
    before = sizes.select("ds_id", F.coalesce(F.sum("_n").over(Window.orderBy("ds_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_low"))
    local = ordered_rank(combined, key, "_k0", "ds_id")
    return local.join(F.broadcast(before), "ds_id").withColumn("position", (F.col("_low") + F.col("_k0")).cast("long")).drop("_low", "_k0")


def member_of(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """position to (ds_id, local): a range lookup in the cumulative sizes (a row for each dataset)."""
    high = F.sum("n").over(Window.orderBy("ds_id"))
    ranges = sizes.select("ds_id", (high - F.col("n")).alias("low"), high.alias("high"))
    return wanted.join(F.broadcast(ranges), (F.col("position") >= F.col("low")) & (F.col("position") < F.col("high"))).select("position", "ds_id", (F.col("position") - F.col("low")).alias("local"))


def weighted_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by weight: the smallest -ln(u)/w. A top-k, so no full sort."""
    u = F.greatest(uniform(F.concat_ws("/", F.col("ds_id"), F.col(key)), seed), F.lit(1e-16))
    return rows.withColumn("draw", -F.ln(u) / F.col("weight")).orderBy("draw", "ds_id", key).limit(n)


def random_order(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return global_rank(rows, shuffle_hash(F.col(key), seed), F.col(key), "position")


#: Draws that one task makes at most, and the shortest stretch between two retirements that is dealt to many.
AT_ONCE = 200_000


def _place(draw: Column, live, seed: int) -> Column:
    """Which of the live classes a draw takes: its own hash decides, so draws need no order."""
    return F.conv(F.substring(shuffle_hash(draw, seed), 1, 8), 16, 10).cast("long") % live


def _in_order(classes: list, batch: int, seed: int, first: int, most: int):
    """(draw, label, number) of draws in order, for classes (label, draws left, draws made); the draw that retires a class has number -1."""
    live = [[label, left, used] for label, left, used in classes]
    k = first
    while len(live) >= batch and k < first + most:
        at = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % len(live)
        if live[at][1] <= 0:
            yield k, live[at][0], -1
            del live[at]
        else:
            live[at][1] -= 1
            live[at][2] += 1
            yield k, live[at][0], live[at][2]
        k += 1


def draws(sizes: DataFrame, batch: int, seed: int = 0, normalise: bool = True) -> DataFrame:
    """batch_id, slot, label, number, for classes (label, n): draw k takes the live class at place hash(seed, k) modulo their number.

    With ``normalise`` a class that has no more rows left than the smallest one had at the start retires when it is drawn, else one
    that has none. It ends when fewer classes than ``batch`` live; a batch that is open then is not given.

    Between two retirements the live classes stay the same, so a stretch of draws is counted by all tasks at once: the first draw
    of a class that has none left ends it. Where stretches are short, one task goes through AT_ONCE draws in
    order. Classes and draws are tables that are written; the driver knows how many classes live and where a stretch ends.
    """
    spark, folder = sizes.sparkSession, work_dir(sizes.sparkSession, "draws")
    parts = []

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    own = sizes.join(F.broadcast(sizes.agg(F.min("n").alias("_least")))) if normalise else sizes.withColumn("_least", F.lit(0))  # one row
    classes = stored(own.select("label", (F.col("n") - F.col("_least")).alias("left"), F.lit(0).cast("long").alias("used")), "classes-0")
    k, step = 0, 0
    while True:
        alive = classes.agg(F.count("*").alias("n"), F.min("left").alias("least"), F.sum("left").alias("all")).first()
        if alive.n < batch:
            break
        step += 1
        if alive.all + alive.n <= AT_ONCE:  # that is all there can be
            parts.append(stored(_one_task(classes, batch, seed, k), f"draws-{step}"))
            break
        stretch = (alive.least + 1) * alive.n  # about as long as it takes the class with the fewest draws left to retire
        if stretch < AT_ONCE:
            made = stored(_one_task(classes, batch, seed, k), f"draws-{step}")
            k += AT_ONCE
        else:
            ranked = ordered_rank(classes, "label", "place")
            asked = spark.range(k, k + stretch).select(F.col("id").alias("draw")).withColumn("place", _place(F.col("draw"), F.lit(alive.n), seed))
            numbered = asked.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("draw"))).join(ranked, "place")
            counted = stored(numbered.select("draw", "label", (F.col("used") + F.col("n")).alias("number"), (F.col("n") > F.col("left")).alias("over")), f"stretch-{step}")
            end = counted.agg(F.min(F.when(F.col("over"), F.col("draw")))).first()[0]
            made = counted if end is None else counted.where(F.col("draw") <= end)
            made = made.select("draw", "label", F.when(F.col("over"), -1).otherwise(F.col("number")).cast("long").alias("number"))
            k = k + stretch if end is None else end + 1
        parts.append(made)
        taken = made.groupBy("label").agg(F.max("number").alias("_most"), F.min("number").alias("_end"))
        left = classes.join(taken, "label", "left").where("_end is null or _end >= 0")
        most = F.coalesce(F.greatest("_most", "used"), F.col("used"))
        classes = stored(left.select("label", (F.col("left") - (most - F.col("used"))).alias("left"), most.alias("used")), f"classes-{step}")
    if not parts:
        return spark.createDataFrame([], "batch_id long, slot int, label string, number long")
    every = reduce(DataFrame.unionByName, parts).where("number > 0")
    ranked = ordered_rank(every, "draw", "_at")
    whole = every.count() // batch * batch
    return ranked.where(F.col("_at") < whole).select(F.floor(F.col("_at") / batch).alias("batch_id"), (F.col("_at") % batch).cast("int").alias("slot"), "label", "number")


def _one_task(classes: DataFrame, batch: int, seed: int, first: int) -> DataFrame:
    def run(frames):
        live = [row for f in frames for row in zip(f["label"], f["left"].tolist(), f["used"].tolist(), strict=True)]
        found = _in_order(live, batch, seed, first, AT_ONCE)
        while some := list(itertools.islice(found, 10_000)):
            yield pd.DataFrame(some, columns=["draw", "label", "number"])

    return classes.repartition(1).sortWithinPartitions("label").mapInPandas(run, "draw long, label string, number long")


def balanced_batches(rows: DataFrame, label: str, key: str, batch: int, seed: int = 0, normalise: bool = True, keep_rest: bool = False) -> DataFrame:
    """batch_id, label, key: classes are drawn with replacement for each batch (``draws``), and of a class its next row in hash order.

    Rows are ranked in their class by ranges of hashes. With ``keep_rest`` the rows that were not drawn follow, in the order of label and rank,
    in batches from the last id on.
    """
    rows = rows.select(label, key)
    counted = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n")).where("label is not null")
    plan = draws(counted, batch, seed, normalise).select("batch_id", "slot", F.col("label").alias("_l"), F.col("number").alias("_n"))
    hashed = rows.withColumn("_l", F.col(label).cast("string")).withColumn("_h", shuffle_hash(F.col(key), seed))
    ranked = ordered_rank(hashed, "_h", "_k", "_l").withColumn("_n", F.col("_k") + 1)
    out = ranked.join(plan, ["_l", "_n"]).select("batch_id", label, key)
    if not keep_rest:
        return out
    rest = ranked.join(plan, ["_l", "_n"], "left_anti").withColumn("_ord", F.concat("_l", F.lit("/"), F.lpad(F.col("_n").cast("string"), 20, "0")))
    last = plan.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("_last"))
    rest = ordered_rank(rest.select("_ord", label, key), "_ord", "_p").join(F.broadcast(last))
    return out.unionByName(rest.select((F.col("_last") + F.floor(F.col("_p") / batch)).cast("long").alias("batch_id"), label, key))


def epoch(rows: DataFrame, key: str, n: int | None = None, seed: int = 0, replace: bool = False) -> DataFrame:
    """draw, key: an epoch of a random sampler. Without replacement the first n of the random order (all by default), with it n draws."""
    ranked = random_order(rows.select(key), key, seed)
    if not replace:
        return (ranked if n is None else ranked.where(F.col("position") < n)).select(F.col("position").alias("draw"), key)
    size = rows.agg(F.count("*").alias("_size"))
    total = rows.count() if n is None else n
    place = F.conv(F.substring(shuffle_hash(F.concat_ws("/", F.lit("draw"), F.col("draw")), seed), 1, 13), 16, 10).cast("long")
    draws = rows.sparkSession.range(total).withColumnRenamed("id", "draw").join(F.broadcast(size.where("_size > 0"))).withColumn("position", place % F.col("_size"))
    return draws.join(ranked, "position").select("draw", key)
