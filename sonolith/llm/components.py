"""Connected components of a distributed edge list, by alternating large and small stars.

Every round is grouped minima and joins on the edges, and is written to shared storage; the
driver sees four numbers a round. Nothing of a component's size meets in one task: a node's
neighbours are dealt in SALTS parts, a node's least neighbour is sent to the parts that it has.
Edge lists of at most FEW edges, which are 16 bytes each, are joined up by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts that the neighbours of one node are dealt in.
SALTS = 64
#: Edges of one written file: few edges make few files, however many partitions they came from.
FILE_EDGES = 200_000
#: Edges that one task joins up: 16 MB.
FEW = 1_000_000


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their components' smallest nodes: roots hook to smaller roots, paths are halved until they end at roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        u, v = root[x], root[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(higher := root[root], root):
            root = higher
    return nodes, nodes[root]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, least = joined_up(np.concatenate(a), np.concatenate(b))
    for at in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(least[at : at + 50_000])], names=["node", "component"])


def _salted(edges: DataFrame, by: str, of: str, least: Column) -> DataFrame:
    """Adds m: the least ``of`` over all rows of ``by``."""
    rows = edges.withColumn("_s", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(by, "_s").agg(F.min(of).alias("_p"))
    whole = parts.groupBy(by).agg(least.alias("m"), F.collect_list("_s").alias("_all"))  # SALTS at most
    return rows.join(whole.select(by, "m", F.explode("_all").alias("_s")), [by, "_s"]).drop("_s")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b), a table that is written; nodes are longs.

    It settles within rounds that grow as the logarithm squared of the longest component; more than ``rounds`` is an error.
    """
    edges = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_one_task, "node long, component long")
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = stored(edges.select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
    seen, count = None, now.count()
    for _ in range(rounds):
        both = now.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("w")))
        large = _salted(both, "n", "w", F.least(F.min("_p"), F.col("n"))).where("w > n").select(*pair(F.col("w"), F.col("m"))).distinct()
        small = _salted(large, "u", "v", F.min("_p"))
        small = small.select(F.explode(F.array(F.when(F.col("v") != F.col("m"), F.struct(*pair(F.col("v"), F.col("m")))), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stored(small.where("e is not null").select("e.*").distinct().coalesce(1 + count // FILE_EDGES), "edges")
        # a digest of the edge set: their number and three independent 64-bit sums of hashes
        digest = [F.expr(f"bit_xor(xxhash64({s}, u, v))") for s in (1, 2)] + [F.sum(F.xxhash64(F.lit(3), "u", "v").cast("decimal(38,0)"))]
        mark = tuple(now.agg(F.count("*"), *digest).first())
        if mark == seen:
            break
        seen, count = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
