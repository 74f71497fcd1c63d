"""WARC archives as a Python data source, ``format("warc")``, for writing and reading.

Writing: a task writes archives of at most ``roll`` bytes, a gzip member for each record.
A member's extra field (``sl``, skip lengths: compressed and plain bytes) lets a reader go
to the next record without inflating this one. Files get their final names when the task
has ended; a failed job's files are removed.

Reading: file partitions are planned by size on the driver, from the manifests, or from the
folder if it has none (archives are never cut; small ones share a partition). Comparisons of ``record_type``, ``target_uri`` and
``payload_digest`` with constants are pushed down; every record's header is inflated and
parsed first, and the rest of a record that a predicate excludes is neither read nor
inflated. With option ``payload=false`` no payload is. Members without that extra field,
from other writers, are inflated to find their ends.

Defined results: a null payload is an empty one; a null url is written as no target; a
null id is kept (and is never the one that others refer to, unless all ids of that payload
are null; then all are responses); repeated rows with one id are each a record: where it
is the largest id of its payload, all of them are responses; an empty table gives no
archives and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path, text_of
from .storage import opened

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
#: What is read of a record to find its header.
PEEK = 2048
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("payload", pa.binary())])
_PUSHED = ("record_type", "target_uri", "payload_digest", "refers_to", "record_id")
_BREAKS = re.compile(r"[\r\n]+")


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member with its own lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, digest: str, refers_to: str | None, length: int, payload: bytes | None) -> bytes:
    block = _HTTP + (payload or b"") if kind == "response" else _HTTP
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + _BREAKS.sub("%0A", uri))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


#: Begins the name of a list of committed archives: lines of size and name.
MANIFEST = "manifest-"


@dataclass
class _Files(WriterCommitMessage):
    names: list
    sizes: list


class WarcWriter(DataSourceArrowWriter):
    """Takes record_id, record_type, target_uri, payload_digest, refers_to, payload_length, payload."""

    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        names, sizes, out, size = [], [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_length", "payload")), strict=True):
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                        sizes.append(size)
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(*(x.as_py() for x in row)))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            sizes.append(size)
        return _Files(names, sizes)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        lines = [f"{size} {name}\n" for m in messages if m for name, size in zip(m.names, m.sizes, strict=True)]
        name = f"{root}/{MANIFEST}{uuid.uuid4().hex}.txt"
        with system.open_output_stream(name + ".open", compression=None) as out:
            out.write("".join(lines).encode())
        system.move(name + ".open", name)

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/{name}")


@dataclass
class _Part(InputPartition):
    files: tuple


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, part_bytes: int):
        self.path, self.payload, self.part_bytes, self.wanted = path, payload, part_bytes, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                kind = {EqualTo: "in", In: "in", StringStartsWith: "starts"}[type(f)]
                self.wanted.append((f.attribute[0], kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in ("record_type", "record_id")):  # these two are never null
                yield f

    def partitions(self):
        system, root = opened(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file]
        files = []
        if manifests := [f.path for f in found if f.base_name.startswith(MANIFEST) and f.extension == "txt"]:
            for path in manifests:
                with system.open_input_stream(path, compression=None) as file:
                    pairs = (line.split(" ", 1) for line in file.read().decode().splitlines())
                    files += [(f"{root}/{name}", int(size)) for size, name in pairs]
        else:
            files = [(f.path, f.size) for f in found if f.path.endswith((".warc.gz", ".warc"))]
        files.sort()
        parts, now, size = [], [], 0
        for path, n in files:
            if now and size + n > self.part_bytes:
                parts.append(_Part(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n
        return [*parts, _Part(tuple(now))] if now else parts or [_Part(())]

    def fits(self, row: tuple) -> bool:
        for name, kind, values in self.wanted:
            value = row[_ARROW.get_field_index(name)]
            if value is None or not (value in values if kind == "in" else value.startswith(values[0])):
                return False
        return True

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.files:
            with system.open_input_file(path) as file:
                for row in self.records(file):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 4096 or held > 8_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)

    def records(self, file) -> Iterator[tuple]:
        at, end = 0, file.size()
        while at < end:
            data = file.read_at(min(PEEK, end - at), at)
            size, start = 0, 10
            if data[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at byte {at}")
            if data[3] & 4:
                n = struct.unpack_from("<H", data, 10)[0]
                if n >= 12 and data[12:14] == b"sl":
                    size, start = struct.unpack_from("<I", data, 16)[0], 12 + n
            if not size:  # from another writer: find the member's end
                size, plain = _inflated(file, at, end)
                head, _, rest = plain.partition(b"\r\n\r\n")
                row = self.row(parse_header(head), lambda rest=rest, head=head: rest)
            else:
                unpack = zlib.decompressobj(-15)
                plain = unpack.decompress(data[start:])
                read = len(data)
                while b"\r\n\r\n" not in plain and read < size:
                    more = file.read_at(min(PEEK, size - read), at + read)
                    read += len(more)
                    plain += unpack.decompress(more)
                head, _, rest = plain.partition(b"\r\n\r\n")
                row = self.row(parse_header(head), lambda u=unpack, r=rest, n=read: r if n >= size else r + u.decompress(file.read_at(size - n, at + n)))
            if row:
                yield row
            at += size

    def row(self, header: dict[str, str], rest) -> tuple | None:
        bare = lambda k: header[k].strip("<>") if k in header else None
        digest = header.get("warc-payload-digest")
        row = (bare("warc-record-id"), header.get("warc-type"), header.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), bare("warc-refers-to"), int(header.get("x-payload-length", -1)))
        if not self.fits(row):
            return None
        if not self.payload or row[1] != "response":
            return (*row, None)
        block = rest()[: int(header["content-length"])]
        return (*row, block.partition(b"\r\n\r\n")[2])


def _inflated(file, at: int, end: int) -> tuple[int, bytes]:
    unpack, parts, read = zlib.decompressobj(31), [], 0
    while not unpack.eof and at + read < end:
        data = file.read_at(min(1 << 16, end - at - read), at + read)
        read += len(data)
        parts.append(unpack.decompress(data))
    return read - len(unpack.unused_data), b"".join(parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """Options: path, payload (true), part_bytes (64 MB) for reading, roll (256 MB) for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("part_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", 256 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits, five at a time (20 bits) as four letters."""
    digits = F.sha1(data)
    fours = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Parts that the rows of one payload are dealt in.
SALTS = 256


def planned(pages: DataFrame, minimum: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The records to write: of equal payloads of at least ``minimum`` bytes the one with the largest id is the response.

    Rows meet the largest id of their payload by digest and a salt of their id, so a payload that many pages share is
    dealt in SALTS parts; the other side has a row for each payload and salt that occurs.
    """
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    each = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(text_of(payload_col), "UTF-8").alias("payload"))
    each = each.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_length", F.octet_length("payload").cast("long"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("id", "target_uri"), F.lit(SALTS)).cast("int"))
    by = ["payload_digest", "payload_length"]
    first = each.groupBy(*by, "salt").agg(F.max("id").alias("first")).groupBy(*by).agg(F.max("first").alias("first"), F.collect_list("salt").alias("salts"))
    first = first.select(*by, "first", F.explode("salts").alias("salt"))
    revisit = F.coalesce((F.col("payload_length") >= minimum) & ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    joined = each.join(first, [*by, "salt"])
    return joined.select(urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", F.when(revisit, urn(F.col("first"))).alias("refers_to"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(planned(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    # responses: the payload itself, as stored; revisits: headers only
    responses = read_warc(spark, path).where("record_type = 'response'").select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"), "payload_digest")
    return responses.unionByName(revisits).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
