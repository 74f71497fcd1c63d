"""Centroid clustering: k-means in integers, filtered by metric trees.

Every task gathers its vectors into blocks of BLOCK rows and builds a ball tree of each: a node
is a stretch of the block's points with their centre, the radius about it, their count and
their integer sum. The trees are written once and read in each round. A round goes down a tree with the
centroids that can still be nearest: of two whose distances from a ball's centre differ by more than its
diameter the farther one is nearest to none of its points (triangle inequality), and a ball with one left goes to it
whole, by its count and sum. Leaves are decided point by point, in integers. Sums by
cluster and component are added up by Spark, so the driver holds the centroids and nothing else.

Defined results: vectors with another number of components, or with null or not finite ones,
are left out, and so are null vectors; components are floor(scale * x) held within
+-2^27, so that squared distances fit in a long; null ids are assigned but start no
centroid (if no vector has an id, the result is empty); repeated rows count each; with fewer kept vectors than centroids each one starts one;
ties of ids go by the vector, ties of distance to the smaller number; a centroid without vectors stays; an empty table gives
an empty result; an inertia beyond a long is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settings, stored

#: Components are held within this; squares of differences of 64 such ones add up to a long.
LARGEST = 1 << 27
#: Up to this, products of 64 components add up to less than 2^53, exactly in doubles.
EXACT = 1 << 22
#: Points of a block and of a leaf.
BLOCK, LEAF = 4096, 48
#: Blocks (of 1 to 2 MB) that are read at once.
READ_BLOCKS = 8
BLOCKS = "ids binary, known binary, points binary, nodes binary, centres binary, radii binary, sums binary"


def kept(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: vectors of ``dims`` finite components as integers."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("long"))
    fits = F.when(F.size(x) == dims, ~bad).otherwise(False)
    return table.where(fits).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def starts(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id: a top-k."""
    chosen = vectors.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy("h", "v").limit(k)
    return [list(r.v) for r in chosen.orderBy("h", "v").collect()]


class Tree:
    """nodes (start, end, left, right), left < 0 for leaves; their centres, radii and sums; points in the nodes' order."""

    def __init__(self, points, nodes, centres, radii, sums):
        self.points, self.nodes, self.centres, self.radii, self.sums = points, nodes, centres, radii, sums


def grow(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree of a block (integers) and the order it has brought the points to."""
    order, nodes, centres, radii, sums = np.arange(len(points)), [], [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = points[order[start:end]]
        total = own.sum(axis=0)
        centre = total / (end - start)
        away = ((own - centre) ** 2).sum(axis=1)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        here = len(nodes)
        # a little more than measured, so that rounding never makes a ball too small
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(np.sqrt(away.max()) * (1 + 1e-9) + 1e-9)
        sums.append(total)
        if end - start <= LEAF or not away.any():
            continue
        # the farthest point from the centre and the farthest from that one: points go to the nearer
        a = own[away.argmax()]
        from_a = ((own - a) ** 2).sum(axis=1)
        b = own[from_a.argmax()]
        near = from_a <= ((own - b) ** 2).sum(axis=1)
        if not 0 < near.sum() < len(near):
            continue
        part = order[start:end]
        order[start:end] = np.concatenate([part[near], part[~near]])
        middle = start + int(near.sum())
        todo += [(start, middle, here, 0), (middle, end, here, 1)]
    return Tree(points[order], np.array(nodes, np.int64).reshape(-1, 4), np.array(centres), np.array(radii), np.array(sums, np.int64)), order


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, centroids): by products in doubles where those are exact, else by differences in integers."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and points.shape[1] <= 64:
        p, c = points.astype(float), centroids.astype(float)
        return np.rint((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, int]]:
    """(start, end, cluster, node): whole balls with the one cluster they go to, leaves with their points' clusters and node -1."""
    cents = centroids.astype(float)
    # all balls' distances at once; the slack covers their rounding
    d = np.sqrt(np.maximum((tree.centres**2).sum(axis=1)[:, None] - 2 * (tree.centres @ cents.T) + (cents**2).sum(axis=1), 0))
    slack = 1e-6 * (1 + np.sqrt((tree.centres**2).sum(axis=1).max(initial=0) + (cents**2).sum(axis=1).max(initial=0)))
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, alive = todo.pop()
        start, end, left, right = tree.nodes[node]
        away = d[node, alive]
        alive = alive[away - tree.radii[node] <= away.min() + tree.radii[node] + slack]
        if len(alive) == 1:
            yield start, end, int(alive[0]), node
        elif left < 0:
            yield start, end, alive[squared(tree.points[start:end], centroids[alive]).argmin(axis=1)], -1
        else:
            todo += [(left, alive), (right, alive)]


def _packed(ids: list, points: list, dims: int) -> pa.RecordBatch:
    ids, block = pa.concat_arrays(ids), np.concatenate(points)
    tree, order = grow(block)
    known = np.asarray(ids.is_valid())[order]
    numbers = np.asarray(ids.fill_null(0))[order]
    columns = [numbers.astype(np.int64), known, tree.points.astype(np.int32), tree.nodes, tree.centres, tree.radii, tree.sums]
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=[c.split()[0] for c in BLOCKS.split(", ")])


def _grown(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(BLOCK - held, batch.num_rows - at))
                at += part.num_rows
                held += part.num_rows
                ids.append(part.column(0))
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if held == BLOCK:
                    yield _packed(ids, points, dims)
                    ids, points, held = [], [], 0
        if held:
            yield _packed(ids, points, dims)

    return run


def trees(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """A row a block: its ids and its tree, as arrays' bytes."""
    return vectors.mapInArrow(_grown(dims), BLOCKS)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    for row in range(batch.num_rows):
        of = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
        tree = Tree(of("points", np.int32).reshape(-1, dims).astype(np.int64), of("nodes", np.int64).reshape(-1, 4), of("centres", float).reshape(-1, dims), of("radii", float), of("sums", np.int64).reshape(-1, dims))
        yield of("ids", np.int64), of("known", bool), tree


def _added(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, _, tree in _opened(batch, dims):
                for start, end, cluster, node in filtered(tree, centroids):
                    if node >= 0:
                        counts[cluster] += end - start
                        sums[cluster] += tree.sums[node]
                    else:
                        counts += np.bincount(cluster, minlength=k)
                        np.add.at(sums, cluster, tree.points[start:end])
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(counts[hit]), pa.array(list(sums[hit]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    return run


def _few_blocks(spark: SparkSession):
    """Blocks are read, and handed to workers, READ_BLOCKS at a time."""
    return settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": READ_BLOCKS, "spark.sql.execution.arrow.maxRecordsPerBatch": READ_BLOCKS})


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the clusters' means; a centroid without vectors stays. Collects a row a cluster."""
    parts = blocks.mapInArrow(_added(np.array(centroids, np.int64)), "cluster int, n long, s array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(j)).cast("decimal(38,0)")) for j in range(len(centroids[0])))).alias("s"))
    out = list(centroids)
    with _few_blocks(blocks.sparkSession):
        found = total.collect()
    for r in found:
        out[r.cluster] = [int(x) // r.n for x in r.s]
    return out


def _named(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, tree in _opened(batch, centroids.shape[1]):
                own = np.empty(len(ids), np.int64)
                for start, end, cluster, _ in filtered(tree, centroids):
                    own[start:end] = cluster
                away = np.empty(len(ids), np.int64)
                for c in np.unique(own):
                    away[own == c] = squared(tree.points[own == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(own, pa.int32()), pa.array(away)], names=["vec_id", "cluster", "distance"])

    return run


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector, written."""
    rows = blocks.mapInArrow(_named(np.array(centroids, np.int64)), "vec_id long, cluster int, distance long")
    with _few_blocks(blocks.sparkSession):
        return stored(rows, "ball-clusters")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """Vectors (vec_id, v) with their clusters after so many rounds, and the centroids."""
    blocks = stored(trees(vectors, dims), "ball-trees")
    centroids = starts(vectors, k, seed)
    if not centroids:  # then no vector has an id
        none = blocks.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
        return none, []
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return assigned(blocks, centroids), centroids


def _chosen(values: list, column: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), column)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    long = lambda x: x if x < 1 << 63 else None
    each = [long(inertia.get(c, 0)) for c in range(len(centroids))] or [0]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    return rows.select("vec_id", "cluster", "distance", _chosen(each, F.col("cluster")).cast("long").alias("cluster_inertia"), F.lit(long(sum(inertia.values()))).cast("long").alias("inertia"), _chosen(digests, F.col("cluster")).alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Assignments and means, round by round: a row a vector, centroid and component nowhere, lists throughout."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""near{r} as (select row, vec_id, v, arg_min(c, (d, c)) as cluster, min(d) as distance from (
    select row, vec_id, v, c.c, list_sum(list_transform(list_zip(v, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from vectors cross join cents{r} c) group by row, vec_id, v)""")
        if r < rounds:
            out.append(f"""means{r} as (select cluster as c, list(m order by i) as w from (
    select cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from near{r}) group by cluster, i) group by cluster),
cents{r + 1} as (select c.c, coalesce(m.w, c.w) as w from cents{r} c left join means{r} m using (c))""")
    return ",\n".join(out)


OP12_SQL = f"""with vectors as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
cents0 as (select row_number() over (order by h, v) - 1 as c, v as w from (select v, sha256('1:' || vec_id::varchar) as h from vectors where vec_id is not null) order by h, v limit 16),
{_rounds_sql(3)}
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(w, ',')) as centroid_sha256 from near3 n join cents3 c on c.c = n.cluster"""
