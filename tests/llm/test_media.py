"""Media columns: exact round trips, sharing, header reads."""

import hashlib
import tarfile
import zlib

from sonolith.llm import media as m


def tmp_path_media(spark):
    from pathlib import Path

    from sonolith.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "sonolith"
    newest = max((p for p in folder.iterdir() if p.name.startswith("media-") and any(p.glob("*.tar"))), key=lambda p: p.stat().st_mtime)
    return newest.glob("*.tar")


def plain_samples(data):
    """A PNG's samples, chunk by chunk and row by row."""
    at, packed = 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IHDR":
            width = int.from_bytes(data[at + 8 : at + 12], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    scan = zlib.decompress(packed)
    return b"".join(scan[k + 1 : k + 1 + width] for k in range(0, len(scan), width + 1))


def test_round_trip(spark, tmp_path):
    texts = ["", None, "a", "é" * 1000, "x" * 576, "x" * 577, "long " * 60_000, "a", "ÿ" * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "again")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, digest string, offset int").repartition(2)
    path = tmp_path / "t"
    df.write.parquet(str(path / "documents.parquet"))
    got = m.op10_media_columns(spark, str(path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = next(r for r in by[i] if r.n_bytes == len(data))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.width, r.height) == (576, len(payload) // 576)
    stored = {}
    for tar in tmp_path_media(spark):
        with tarfile.open(tar) as shard:
            for member in shard.getmembers():
                stored[member.name] = shard.extractfile(member).read()
    for r in got:
        media = stored[f"{r.payload_sha256}.png"]
        x = plain_samples(media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        mean, size = sum(x) / len(x), len(x) // 64
        bits = "".join(str(int(sum(x[k * size : (k + 1) * size]) / size > mean)) for k in range(64))
        assert r.feature == f"{int(bits, 2):016x}-{mean:.3f}"
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in got if r.n_bytes == 1}) == 1
    empty = tmp_path / "e"
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert m.op10_media_columns(spark, str(empty)).count() == 0


def test_shards_are_tar_files_addressed_by_content(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string").repartition(3)
    rows = m.write_shards(df, f"file://{tmp_path}/shards")
    index = m.index_of(rows)
    assert index.count() == 5
    for r in index.collect():
        with tarfile.open(r.shard) as tar:
            info = tar.getmember(f"{r.digest}.png")
            assert (info.offset_data, info.size) == (r.offset, r.length)
            assert hashlib.sha256(m.png_samples(tar.extractfile(info).read())).hexdigest() == r.digest
    assert all(r.width == 576 and r.bits == 8 for r in m.with_headers(m.in_shards(index)).collect())
