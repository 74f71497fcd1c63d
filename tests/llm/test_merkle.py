"""Merkle manifest: leaves, roots, proofs and folds against trees built in Python; nulls, ties, one source, empty tables."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sonolith.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def _tree(nodes):
    """The root and each node's (before, after) digests, level by level."""
    paths, spans = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, wider = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for j in range(len(run)):
                for leaf in spans[a + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(_h(*run))
            wider.append(sum(spans[a : a + 3], []))
        nodes, spans = above, wider
    return nodes[0], paths


def _brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees.append((own, *_tree([_leaf(r, r[1]) for r in own])))
    root, up = _tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, up):
        for r, path in zip(own, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            fold = _leaf(r, r[1].replace("\n", "") if tampered else r[1])
            for before, after in path + top:
                fold = _h(before, fold, after)
            out.append((r[0], _leaf(r, r[1]), subroot, root, _h(*(b + a for b, a in path + top)), fold, fold == root))
    return out


def _rows():
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choices(["ein", "zwei ä", "", "drei\n"], k=rng.randrange(9))), rng.choice(["de", None]), rng.choice(["big"] * 6 + ["b", "ä", "z", None]), rng.choice([None, k])) for k in rng.sample(range(5000), 260)]
    rows += [(7, "x\ny", "de", "lone", 3), (None, "a\nb", "de", "big", 1), (None, None, None, None, None), (9, "x", "de", "big", 1), (9, "y\n", "de", "big", 1), (9, "x", "de", "big", 1), (11, "a\n" * 200_000, "de", "b", 2)]
    return rows


def _query(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(7).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return m.op13_merkle_manifest(spark, str(tmp_path))


def test_query_against_trees_in_python(spark, tmp_path):
    rows = _rows()
    got = [tuple(r) for r in _query(spark, tmp_path, rows).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(_brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_sql_of_nulls_and_ties(spark, tmp_path):
    rows = [r for r in _rows() if len(r[1] or "") < 1000]
    got = _query(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(m.OP13_SQL)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, tmp_path, n):
    rows = [(k, f"t{k}\n", "en", "one", k) for k in range(n)]
    got = [tuple(r) for r in _query(spark, tmp_path, rows).collect()]
    assert sorted(got) == (sorted(_brute(rows)) if rows else [])
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256().hexdigest()


def test_extra_columns_and_other_fields(spark):
    docs = spark.createDataFrame([(k, "x", "en", f"s{k % 2}", 1, 5, 6, "p", "n") for k in range(8)], SCHEMA + ", pos int, tree int, path string, digest string")
    manifest = m.build(docs, fields=("doc_id", "text"), seen=F.col("pos"))
    found = m.proofs(manifest)
    assert found.count() == 8 and found.where(m.folded(F.col("leaf"), F.col("path")) == manifest.root).count() == 8
    assert {r.seen for r in found.collect()} == {5}
    # every level is a third of the one below, rounded up by source
    assert [level.count() for level in manifest.levels] == [8, 4, 2]
