"""SimHash: the fingerprints and links against brute force."""

import numpy as np
import pytest
import xxhash

from sonolith.llm import simhash


def brute(texts, shingle=4):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return out


def closed(ids, prints, limit=4):
    """Smallest id reachable, by repeated full comparison."""
    values = sorted(set(prints))
    v = np.array(values, np.uint64)
    least = {p: min(i for i, q in zip(ids, prints) if q == p) for p in values}
    label = np.array([least[p] for p in values])
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= limit
    while True:
        new = np.where(near, label[None, :], label.max() + 1).min(axis=1)
        if (new == label).all():
            return [int(label[values.index(p)]) for p in prints]
        label = new


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, component_id int, node int")
    found = {(r.doc_id): (r.fp, r.component_id) for r in simhash.near_duplicates(df, simhash.contract_ring()).selectExpr("doc_id", "lower(hex(w[0])) fp", "component_id").collect()}
    ids, prints = [r[0] for r in rows], brute([r[1] for r in rows])
    want = closed(ids, prints)
    for i, p, c in zip(ids, prints, want):
        assert int(found[i][0], 16) == p
        assert found[i][1] == c
    return want


def test_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text, "x", 1, 1) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"word{i}" for i in range(300))
    rows += [(5000 + i, base.replace(f"word{i % 290} ", f"other{i} "), "x", 1, 1) for i in range(60)]
    rows += [(6000, None, None, None, None), (6001, "", "", 0, 0), (6002, " \t\n", "", 0, 0), (6003, "one", "", 0, 0), (6004, "ONE", "", 0, 0), (6005, "x " * 50_000, "", 0, 0)]
    want = check(spark, rows)
    assert len(set(want[1000:1060])) < 30  # long runs were searched


def test_null_id_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df, simhash.contract_ring()).collect())
    assert got == [(-1, None), (3, 3), (3, 3)]
    assert simhash.near_duplicates(df.limit(0), simhash.contract_ring()).count() == 0


def test_group_search_equals_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    w = np.array([base[0] ^ np.uint64(int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)))) for _ in range(400)], np.uint64)
    nodes = np.arange(400)
    a, b = simhash.group_edges(nodes, w[:, None], 4)
    root = nodes.copy()
    for x, y in zip(a, b):
        root[x] = root[y]
    near = np.bitwise_count(w[:, None] ^ w[None, :]) <= 4
    label = nodes.copy()
    while True:
        new = np.where(near, label[None, :], 400).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(0, 400, 7) for j in range(400))


def test_the_pigeonring_filter_loses_nothing_within_the_limit(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [tuple(int(v) for v in rng.multinomial(t, rng.dirichlet(np.ones(4)))) for t in rng.integers(60, 140, 2000)]
    rows = [r for r in rows if max(r) <= 64]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    kept = df.where(simhash.chained([F.col(x) for x in "abcd"], 96)).collect()
    assert sorted(map(tuple, kept)) == sorted(r for r in rows if sum(r) <= 96)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components(spark, few, monkeypatch):
    from sonolith.llm import components as c

    monkeypatch.setattr(c, "FEW", few)
    assert c.components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000 - i, 5000) for i in range(1, 300)]
    got = dict(c.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{1000 + i: 1000 for i in range(500)}, **{5000 - i: 4701 for i in range(300)}}
    assert got == want
