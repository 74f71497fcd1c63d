"""Splits by ratio: of rows, of whole labels, and of labels so that the parts' row counts fit the ratios."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import global_rank, ordered_rank, shuffle_hash
from ..store import work_dir


def _part(rank: Column, n: Column, ratios: dict[str, float]) -> Column:
    """Parts take floor(ratio * n) ranks each, in the order of the ratios; what remains belongs to none."""
    out, low = F.lit(None).cast("string"), F.lit(0)
    bounds = []
    for name, ratio in ratios.items():
        high = low + F.floor(F.lit(float(ratio)) * n)
        bounds.append((name, low, high))
        low = high
    for name, low, high in reversed(bounds):
        out = F.when((rank >= low) & (rank < high), name).otherwise(out)
    return out


def _checked(ratios: dict[str, float]) -> None:
    if not ratios or any(r <= 0 for r in ratios.values()) or sum(ratios.values()) > 1 + 1e-9:
        raise ValueError("ratios are above 0 and sum up to 1 at most")


def split_rows(rows: DataFrame, key: str, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds split. Rows stand in hash order; remainders of the floors have none (null)."""
    _checked(ratios)
    ranked = global_rank(rows, shuffle_hash(F.col(key), seed), F.col(key), "_rank")
    n = rows.agg(F.count("*").alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn("split", _part(F.col("_rank"), F.col("_n"), ratios)).drop("_rank", "_n")


def split_labels(rows: DataFrame, labels: list[str], ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds split; rows with equal labels stay together. Several labels count as their combination."""
    _checked(ratios)
    label = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels))
    named = rows.withColumn("_label", label)
    distinct = split_rows(named.select("_label").distinct(), "_label", ratios, seed)
    return named.join(distinct, "_label").drop("_label")


def balanced_plan(sizes, ratios: dict[str, float], total: int, tolerance: float = 0.1):
    """(label, part) of labels that come smallest first: each goes to the first part, in turn, that stays under floor(ratio * total)
    plus the tolerance (a share of ratio * total); else to none. Whether it was placed or not, the turn goes one part back."""
    names, taken = list(ratios), dict.fromkeys(ratios, 0)
    room = {p: math.floor(r * total) + tolerance * total * r for p, r in ratios.items()}
    for i, (label, n) in enumerate(sizes):
        order = (names[(k - i) % len(names)] for k in range(len(names)))
        part = next((p for p in order if taken[p] + n < room[p]), None)
        if part is not None:
            taken[part] += n
        yield label, part


#: Labels that one task places at most, and labels of a block whose sizes are added up beforehand.
AT_ONCE, BLOCK = 100_000, 10_000


def split_balanced(rows: DataFrame, label: str, ratios: dict[str, float], tolerance: float = 0.1) -> DataFrame:
    """Adds split, as ``balanced_plan`` places the labels. Up to AT_ONCE of them pass through one task, more are placed by stretches."""
    _checked(ratios)
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    counted = rows.groupBy(text.alias("_label")).agg(F.count("*").alias("n"))
    known = counted.agg(F.count("*").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    plan = (_one_task if known.labels <= AT_ONCE else _stretches)(counted, ratios, known.rows, tolerance)
    return rows.withColumn("_label", text).join(plan, "_label").drop("_label")


def _stretches(counted: DataFrame, ratios: dict[str, float], total: int, tolerance: float) -> DataFrame:
    """Labels come smallest first, so a part that has no room for one has none for any later one: it is full for good.

    While the same parts are open a label's place alone tells its part. The block, then the label that would fill a part too far is found from
    running sums, the part is closed, and the next stretch begins with that label: one stretch a part.
    """
    spark, names = counted.sparkSession, list(ratios)
    room = [math.floor(r * total) + tolerance * total * r for r in ratios.values()]
    place = f"{work_dir(spark, 'balanced')}/labels"
    ordered_rank(counted.withColumn("_o", F.concat(F.lpad(F.col("n").cast("string"), 20, "0"), F.lit("/"), F.col("_label"))), "_o", "i").drop("_o").write.parquet(place)
    ranked = spark.read.parquet(place).withColumn("block", F.floor(F.col("i") / BLOCK))
    open_, begin, taken, out = set(range(len(names))), 0, [0] * len(names), None
    while True:
        turn = F.array(*(F.array(*(F.lit(p) for k in range(len(names)) if (p := (k - t) % len(names)) in open_)).cast("array<int>") for t in range(len(names))))
        part = F.get(F.get(turn, (F.col("i") % len(names)).cast("int")), F.lit(0))
        own = ranked.where(F.col("i") >= begin).withColumn("p", part)
        sums = {} if not open_ else {(r.p, r.block): r.s for r in own.groupBy("p", "block").agg(F.sum("n").alias("s")).collect()}  # a number for each part and BLOCK labels
        first = None
        for p in open_:
            held, bad = taken[p], None
            for b in sorted(b for q, b in sums if q == p):
                if held + sums[p, b] >= room[p]:
                    bad = b
                    break
                held += sums[p, b]
            if bad is not None:
                run = F.sum("n").over(Window.orderBy("i")) + F.lit(held)  # within a block
                hit = own.where((F.col("p") == p) & (F.col("block") == bad)).withColumn("run", run).where(F.col("run") >= room[p]).agg(F.min("i")).first()[0]
                first = min(first or (hit, p), (hit, p))
        done = own if first is None else own.where(F.col("i") < first[0])
        named = done.select("_label", F.get(F.array(*map(F.lit, names)), F.col("p")).alias("split"))
        out = named if out is None else out.unionByName(named)
        if first is None:
            return out
        for r in done.groupBy("p").agg(F.sum("n").alias("s")).collect():  # a row a part
            if r.p is not None:
                taken[r.p] += r.s
        begin = first[0]
        open_.discard(first[1])


def _one_task(counted: DataFrame, ratios: dict[str, float], total: int, tolerance: float) -> DataFrame:
    """The labels' sizes, in order, through one task that keeps a number for each part."""

    def placed(batches):
        labels = (row for batch in batches for row in zip(batch["_label"], batch["n"].tolist(), strict=True))
        found = balanced_plan(labels, ratios, total, tolerance)
        while some := list(itertools.islice(found, 10_000)):
            yield pd.DataFrame(some, columns=["_label", "split"])

    return counted.repartition(1).sortWithinPartitions("n", "_label").mapInPandas(placed, "_label string, split string")


def split_by_feature(rows: DataFrame, feature: str, parts: list[str]) -> DataFrame:
    """Adds split: the value of a feature that names the part; a part that no row has is an error."""
    value = F.col(feature).cast("string")
    known = {r[0] for r in rows.where(value.isin(parts)).select(value).distinct().collect()}
    if missing := [p for p in parts if p not in known]:
        raise KeyError(f"feature {feature} has no part {', '.join(missing)}")
    return rows.withColumn("split", F.when(value.isin(parts), value))


def split_report(parts: DataFrame) -> DataFrame:
    """split, rows; the rows without a part are under null."""
    return parts.groupBy("split").agg(F.count("*").alias("n_rows"))


def write_splits(parts: DataFrame, key: str, path: str, name: str = "partitions") -> None:
    parts.where("split is not null").select(F.lit(name).alias("split_name"), "split", F.col(key).alias("key")).write.mode("append").partitionBy("split_name", "split").parquet(path)


def read_splits(spark, path: str, name: str = "partitions") -> DataFrame:
    return spark.read.parquet(path).where(F.col("split_name") == name).select("split", "key")


def read_split_text(spark, path: str) -> DataFrame:
    """split, key from lines ``name;key,key``."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.substring_index("value", ";", 1).alias("split"), F.explode(F.split(F.regexp_extract("value", r"^[^;]*;(.*)$", 1), ",")).alias("key")).where("key <> ''")


def write_split_text(parts: DataFrame, key: str, path: str) -> None:
    """Lines ``name;key,key``, in files of their own for parts of many keys: reading adds the lines of one name up."""
    rows = parts.where("split is not null").select("split", F.col(key).cast("string").alias("key"))
    dealt = rows.groupBy("split", F.pmod(F.xxhash64("key"), F.lit(64)).alias("_part")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    dealt.select(F.concat("split", F.lit(";"), F.array_join("keys", ",")).alias("value")).write.mode("overwrite").text(path)


def has_split(spark, path: str, name: str = "partitions") -> bool:
    """Whether splits of that name are stored."""
    try:
        return not read_splits(spark, path, name).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
