"""Media columns: content-addressed payloads in tar shards, rows with digest, shard, offset and length.

A document's bytes, filled up with 255 to a multiple of the row width, are the samples of
an 8-bit greyscale PNG image. Every task writes one shard, and a payload once in it; the
rows name digest, shard, offset and length, and the index takes one place for each digest,
so at most one copy a shard of even the most frequent payload is written and one is read.
A task that is run again writes another file, and only the rows of the attempt that
counted name a file, so lost executors leave no wrong reference.

Metadata columns come from range reads of the image headers alone (33 bytes a payload).

Defined results: a null text is an empty one (a row of 255s); a null id is kept; repeated
rows share one payload; an empty table gives an empty result; other columns are ignored,
whatever their names. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, text_of
from .storage import opened

WIDTH = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk of an image.
HEADER = 33
#: Digests that a task remembers to write a payload once; beyond it it starts anew and may write copies.
REMEMBERED = 400_000


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    return text + b"\xff" * (-len(text) % width if text else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale image of 8-bit samples; every row is stored without a filter."""
    rows = len(payload) // width
    scan = np.zeros((rows, width + 1), np.uint8)
    scan[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", data[16:25])


def png_samples(data: bytes) -> bytes:
    width, rows, _ = png_header(data[:HEADER])
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    scan = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, width + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows")
    return scan[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits: whether each of 64 bands of the samples is brighter than the whole, and the mean sample."""
    x = np.frombuffer(payload, np.uint8)
    bands = x.reshape(64, -1).mean(axis=1)
    return f"{np.packbits(bands > x.mean()).tobytes().hex()}-{x.mean():.3f}"


_ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _shards(folder: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = opened(folder)
        name = f"{root}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.tar"
        places: dict[bytes, tuple[int, int]] = {}
        out, at = None, 0
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8")
                payload = payload_of(data, width)
                digest = hashlib.sha256(payload)
                if (place := places.get(digest.digest())) is None:
                    media = png(payload, width)
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(name, compression=None)
                    info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    place = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                    if len(places) > REMEMBERED:
                        places.clear()
                    places[digest.digest()] = place
                for column, value in zip(rows, (doc, len(data), digest.hexdigest(), name, *place), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return write


def write_shards(docs: DataFrame, folder: str, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row; the payloads are in tar files in ``folder``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stored(texts.mapInArrow(_shards(folder, width), _ROWS), "media-rows")


def index_of(rows: DataFrame) -> DataFrame:
    """One place for each digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(index: DataFrame, visit: Callable, names: list[str], types: list, schema: str) -> DataFrame:
    """Visit every place, shard by shard in the order of offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    system, path = opened(shard)
                    name, file = shard, system.open_input_file(path)
                found.append(visit(file, offset, length))
            columns = list(zip(*found, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], names=[*batch.schema.names, *names])
        if file is not None:
            file.close()

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(read, f"{own}, {schema}")


def in_shards(index: DataFrame) -> DataFrame:
    return index.repartition("shard").sortWithinPartitions("shard", "offset")


def with_headers(index: DataFrame) -> DataFrame:
    """Adds width, height and bits, from the header bytes alone."""
    visit = lambda file, offset, length: png_header(file.read_at(HEADER, offset))
    return _ranges(index, visit, ["width", "height", "bits"], [pa.int32(), pa.int32(), pa.int32()], "width int, height int, bits int")


def with_features(index: DataFrame) -> DataFrame:
    """Adds what the whole stored bytes give: sizes, checksums and the feature."""

    def visit(file, offset, length):
        media = file.read_at(length, offset)
        payload = png_samples(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return _ranges(index, visit, names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "media"))
    read = with_features(with_headers(in_shards(index_of(rows)))).drop("shard", "offset", "length")
    return rows.select("doc_id", "n_bytes", "digest").join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
