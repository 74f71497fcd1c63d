"""Suffix-array dedup against brute force over all strings."""

import hashlib
import tracemalloc

import numpy as np
import pytest

from sonolith.llm import suffix_dedup as s
from sonolith.llm.common import READ_ROWS, stored


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b, key = (t or "").encode(), s._NO_ID if d is None else d
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(first.get(g, s._NO_ID + 1), key)
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), s._NO_ID if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[5][1]
    rows += [(90_000, base[:60]), (90_001, base[3:52] + "X"), (90_002, "ab" * 400), (90_003, "ab" * 90 + "c"), (90_004, " " * 300), (90_005, " " * 49), (90_006, None), (90_007, "")]
    rows += [(90_008, rows[7][1][:200] + "é" * 60), (90_009, "é" * 40 + rows[9][1][-120:]), (None, base), (None, base), (90_010, base), (90_010, base), (-5, rows[3][1][10:90])]
    return rows


@pytest.mark.parametrize("hot", [200_000, 3])
def test_against_brute_force(spark, tiny, hot, monkeypatch):
    monkeypatch.setattr(s, "BUCKET", 30_000)
    rows = rows_of(spark, tiny)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, start int").repartition(4)
    got = sorted(map(tuple, s.suffix_dedup(df, chunk=40_000, hot=hot).collect()), key=str)
    assert got == brute(rows)


def test_kept_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "0123456789" * 6), (2, "0123456789" * 6 + "tail")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in s.without_repeats(df).collect()}
    assert kept == {1: "a" * 10 + "0123456789" * 6, 2: "tail"}
    assert s.suffix_dedup(df.limit(0)).count() == 0


def test_long_stretches_are_cut(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    start = np.array([0, 10, 10, 3000, 5000])
    whole = s.anchors(data, start, 50)
    monkeypatch.setattr(s, "STRETCH", 700)
    cut = s.anchors(data, start, 50)
    covered = lambda r: sorted((int(a), p) for a, lo, hi in zip(r[0], r[2], r[3]) for p in range(lo, hi + 1))
    assert covered(whole) == covered(cut)
    assert [p for _, p in covered(whole)] == sorted([*range(10, 2951), *range(3000, 4951)])


def test_ranks_double_to_the_length():
    texts = [b"0123456789" * 6, b"x" + b"0123456789" * 5 + b"y", b"z" * 60]
    where, place, rank = s.ranks(texts, 50)
    strings = {}
    for w, p, r in zip(where, place, rank):
        strings.setdefault(int(r), set()).add(texts[w][p : p + 50])
    assert all(len(v) == 1 for v in strings.values())
    assert {(int(w), int(p)) for w, p in zip(where, place)} == {(0, 0), (0, 10), (1, 1)} | {(2, p) for p in range(11)}


def test_rows_go_along_with_their_chunks(spark):
    """Other columns, whatever their names and types, stay with their rows; null texts stay null."""
    passage = "0123456789" * 6
    rows = [(k, f"own {k} " + passage if k % 3 else None, [k, k + 1], {"a": k}, f"c{k}", True, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, carried array<int>, none map<string,int>, c0 string, kept boolean, ids long").repartition(4)
    got = {r.doc_id: r for r in s.without_repeats(df, chunk=500).collect()}
    assert list(got[0].asDict()) == df.columns and len(got) == 60
    for k, text, carried, none, c0, kept, ids in rows:
        r = got[k]
        assert (r.carried, r.none, r.c0, r.kept, r.ids) == (carried, none, c0, kept, ids)
        assert text is None or k == 1 or (text.startswith(r.text) and len(r.text) < 8)
    assert got[1].text == rows[1][1] and got[3].text is None
    assert s.without_repeats(df.limit(0)).columns == df.columns


def test_documents_are_read_in_small_batches(spark, tiny, monkeypatch):
    """What the executors' heap has to hold of texts at once is bounded while chunks are made, and the session is then as before."""
    name, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    monkeypatch.setattr(s, "stored", lambda df, to: (seen.append(int(spark.conf.get(name))), stored(df, to))[1])
    for own in (None, "100"):
        if own:
            spark.conf.set(name, own)
        assert s.suffix_dedup(spark.read.parquet(f"{tiny}/documents.parquet")).count() > 0
        assert spark.conf.get(name, None) == own
    spark.conf.unset(name)
    assert seen == [READ_ROWS, 100]


def test_a_chunk_takes_little_memory():
    data = np.random.default_rng(1).integers(97, 123, s.CHUNK, dtype=np.uint8)
    tracemalloc.start()
    s.anchors(data, np.arange(0, s.CHUNK + 1, 2000), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000


def test_rows_of_a_chunk_meet_without_a_sort(spark, tiny):
    """A join would sort its sides: arrays of tens of MB in every task. What is left to sort are the two tables of buckets."""
    plan = s.suffix_dedup(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
