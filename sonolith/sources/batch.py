"""Work on many files that can stop and go on, and that several jobs can share.

Inputs are claimed a batch at a time, in a table of a ``Store``: a claim is seen by all jobs once its snapshot is there, and of
two jobs that claim at once one has to look again. Outputs and the mark that their inputs are done become
visible together, so each input's output is there once or not at all. A claim older than ``age`` seconds, of a job that
died, counts no more; if such a job comes back after all, its outputs are thrown away.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Conflict, Store

TABLES = {"claims": "key string, job string, at double", "done": "key string, job string"}


def _state(spark: SparkSession, store: Store, table: str, snapshot: dict | None) -> DataFrame:
    if snapshot is None or table not in snapshot["tables"]:
        return spark.createDataFrame([], TABLES[table])
    return store.read(table, snapshot)


def _latest(store: Store) -> dict | None:
    return store.snapshot() if store.versions() else None


def claim(store: Store, inputs: DataFrame, key: str, job: str, batch: int = 1000, age: float = 3600.0, now: Callable[[], float] = time.time) -> DataFrame | None:
    """The next inputs that are neither done nor claimed, as this job's own; None if there are none."""
    spark = store.spark
    while True:
        change, seen = store.change("claim"), _latest(store)
        if (seen or {"version": 0})["version"] != change.base["version"]:
            continue
        taken = _state(spark, store, "claims", seen).where(F.col("at") > now() - age).select("key").unionByName(_state(spark, store, "done", seen).select("key")).distinct()
        open_ = inputs.withColumn("key", F.col(key).cast("string")).join(taken, "key", "left_anti")
        wanted = open_.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(batch).select("key", F.lit(job).alias("job"), F.lit(float(now())).alias("at"))
        ours = change.append("claims", wanted)
        if ours.isEmpty():
            return None
        try:
            change.commit(change.base["meta"])
        except Conflict:
            continue
        return inputs.withColumn("_key", F.col(key).cast("string")).join(F.broadcast(ours.select(F.col("key").alias("_key"))), "_key", "left_semi").drop("_key")  # a batch of keys


def finish(store: Store, claimed: DataFrame, key: str, outputs: DataFrame, job: str, table: str = "outputs") -> bool:
    """Adds the outputs and marks the inputs as done; False, and nothing is added, if another job has done one of them meanwhile."""
    change = store.change("finish")
    change.append(table, outputs)
    keys = change.append("done", claimed.select(F.col(key).cast("string").alias("key"), F.lit(job).alias("job")).distinct())
    while True:
        if not keys.join(_state(store.spark, store, "done", change.base), "key", "left_semi").isEmpty():
            return False
        try:
            change.commit(change.base["meta"])
            return True
        except Conflict:
            change = change.rebased()


def run(store: Store, inputs: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], batch: int = 1000, age: float = 3600.0, table: str = "outputs", job: str | None = None) -> int:
    """Works through the inputs batch by batch until none is left to claim; gives the number of batches that this job finished."""
    job, n = job or uuid.uuid4().hex, 0
    while (claimed := claim(store, inputs, key, job, batch, age)) is not None:
        n += finish(store, claimed, key, work(claimed), job, table)
    return n
