"""Centroid clustering: against plain numpy and SQL, far apart and equal points, large values, odd vectors."""

import hashlib
import math
import random

import duckdb
import numpy as np

from sonolith.llm import ball_tree as b

SCHEMA = "vec_id long, embedding array<double>"


def _brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(by[j]) for x in zip(*by[j])] if j in by else c for j, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in found]


def _rows():
    rng = random.Random(2)
    centres = [[rng.uniform(-9, 9) for _ in range(64)] for _ in range(9)]
    rows = [(k, [x + rng.gauss(0, 0.02 if k % 3 else 3) for x in rng.choice(centres)]) for k in range(700)]
    rows += [(1000 + k, [0.25] * 64) for k in range(150)]  # one very common vector
    rows += [(5, rows[5][1]), (None, [1.0] * 64), (2000, [1.0] * 63), (2001, None), (2002, [math.nan] + [0.0] * 63), (2003, [math.inf] + [0.0] * 63), (2004, [None] + [0.0] * 63), (2005, []), (2006, [-0.001] * 64)]
    return rows


def _query(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(5).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return b.op12_centroid_clusters(spark, str(tmp_path))


def _same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_query_against_plain_loops_and_sql(spark, tmp_path):
    rows = _rows()
    got = _query(spark, tmp_path, rows)
    assert _same(map(tuple, got.collect()), _brute(rows))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(b.OP12_SQL)
    assert [c[0] for c in found.description] == got.columns and _same(found.fetchall(), map(tuple, got.collect()))


def test_few_and_no_vectors(spark, tmp_path):
    for rows in ([], [(3, [0.5] * 64)], [(k, [float(k)] * 64) for k in range(5)] * 2, [(None, [0.5] * 64)]):
        assert _same(map(tuple, _query(spark, tmp_path, rows).collect()), [] if rows and rows[0][0] is None else _brute(rows))


def test_large_values_are_exact_and_held(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-2e6, 2e6) for _ in range(64)]) for k in range(80)]
    long = lambda r: tuple(x if isinstance(x, str) or x < 2**63 else None for x in r)
    got = [tuple(r) for r in _query(spark, tmp_path, rows).collect()]
    assert _same(got, map(long, _brute(rows))) and {r[4] for r in got} == {None}
    assert _query(spark, tmp_path, [(1, [1e300] * 64), (2, [-1e300] * 64)]).count() == 2


def test_whole_balls_are_assigned_and_trees_are_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-3, 3, (900, 64)) + 500 * c for c in range(4)] + [np.full((300, 64), 77)])
    tree, order = b.grow(points)
    assert (points[order] == tree.points).all() and sorted(order) == list(range(len(points)))
    for (start, end, *_), centre, radius, total in zip(tree.nodes, tree.centres, tree.radii, tree.sums):
        assert (tree.points[start:end].sum(axis=0) == total).all()
        assert np.sqrt(((tree.points[start:end] - centre) ** 2).sum(axis=1)).max() <= radius
    centroids = np.array([[500 * c] * 64 for c in range(4)])
    found = np.empty(len(points), int)
    whole = 0
    for start, end, cluster, node in b.filtered(tree, centroids):
        found[start:end] = cluster
        whole += (end - start) * (node >= 0)
    assert (found == b.squared(tree.points, centroids).argmin(axis=1)).all()
    assert whole == len(points)


def test_other_columns_and_dimensions(spark):
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0], 7, "x") for k in range(50)], SCHEMA + ", cluster int, v string")
    out, cents = b.cluster(b.kept(rows, dims=2), k=3, dims=2)
    assert out.count() == 50 and len(cents) == 3
    assert out.agg({"distance": "max"}).first()[0] == 0 or len({tuple(c) for c in cents}) < 3
