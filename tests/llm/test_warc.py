"""WARC: round trips, pushdown, foreign members, ties."""

import base64
import gzip
import hashlib

import pytest

from sonolith.llm import warc as w


def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/é", ""), (4, "http://b/", None), (5, "u\r\nv", "y" * 200_000), (None, "n", "<p>x</p>"), (6, "http://c/", "z"), (6, "http://c/", "z"), (7, "", "HTTP/1.1\r\n\r\nbody")]
    return rows, spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, payload string, first int").repartition(3)


def want(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = i != top and top is not None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows, df = pages(spark)
    path = tmp_path / "t"
    df.write.parquet(str(path / "pages.parquet"))
    got = sorted(map(tuple, w.op9_warc(spark, str(path)).collect()), key=str)
    assert got == want(rows)
    df.limit(0).write.parquet(str(tmp_path / "e" / "pages.parquet"))
    assert w.op9_warc(spark, str(tmp_path / "e")).count() == 0


def test_archives_are_readable_gzip_and_filters_reach_the_source(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "arc")
    w.write_warc(w.planned(df), path)
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "arc").glob("*.warc.gz"))
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    some = w.read_warc(spark, path).where("record_type = 'response' and target_uri like 'http://c/%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # of the two conditions none is left to filter after the scan
    assert "BatchScan" in plan and "StartsWith" not in plan and " = response" not in plan
    assert sorted(r.target_uri for r in some.collect()) == ["http://c/"] * 2
    assert w.read_warc(spark, path, payload=False).where("payload is not null").count() == 0
    assert {r.record_id: r.payload for r in w.read_warc(spark, path).where("record_type = 'response'").collect()}["urn:page:7"] == b"HTTP/1.1\r\n\r\nbody"


def test_members_of_other_writers(tmp_path):
    data = gzip.compress(w.record("response", "urn:page:1", "http://a", "D", None, 3, b"abc")) + w.member(w.record("response", "urn:page:2", "http://b", "D", None, 3, b"xyz"))
    (tmp_path / "x.warc.gz").write_bytes(data)
    reader = w.WarcReader(str(tmp_path), True, 1)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload"]) for r in got] == [("urn:page:1", b"abc"), ("urn:page:2", b"xyz")]


def test_minimum(spark):
    rows, df = pages(spark)
    kinds = {r.record_id: r.record_type for r in w.planned(df, minimum=5).collect()}
    assert kinds["urn:page:3"] == kinds["urn:page:4"] == "response" and kinds["urn:page:1"] == "revisit"


def test_a_repeated_task_leaves_no_duplicates(spark, tmp_path):
    """A task that ran twice has written its archives twice; the job knows of one message."""
    import pyarrow as pa

    writer = w.WarcWriter(str(tmp_path / "arc"), 1 << 20)
    columns = [["response", "response"], ["urn:page:1", "urn:page:2"], ["http://a", None], ["D1", "D2"], [None, None], [3, 3], [b"abc", b"xyz"]]
    names = ["record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_length", "payload"]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    writer.write(iter([batch]))  # its message was lost with its executor
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(r.record_id for r in w.read_warc(spark, str(tmp_path / "arc")).collect()) == ["urn:page:1", "urn:page:2"]
    lost = writer.write(iter([batch]))
    writer.abort([lost, None])
    assert len(list((tmp_path / "arc").glob("*.warc.gz"))) == 2 and w.read_warc(spark, str(tmp_path / "arc")).count() == 2


@pytest.mark.parametrize("data", [b"", b"abc", bytes(range(256))])
def test_base32(spark, data):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(w.base32_sha1(F.col("b")).alias("d")).first().d
    assert got == base64.b32encode(hashlib.sha1(data).digest()).decode()
