"""Suffix-array dedup: every byte that a repeated string of ``length`` bytes covers goes, but in its smallest document.

Ranks of positions double from 8 bytes on until they are unique or past the length. Sorting
every position of the corpus at every doubling would move tens of bytes a position and
round, so positions leave beforehand, without loss:

1. Documents are put together to chunks of some MB, in files of the shared folder (a retried
   task writes other files; only those of the attempt that counted are read).
2. A string of ``length`` bytes has an anchor: of its pieces of GRAM bytes that with the least
   hash, the leftmost of equals. Equal strings have equal anchors at equal places, and
   neighbouring strings mostly share theirs, so there is one anchor for some 16 positions.
   Spark deals the anchors by hash; where a hash occurs once, all its positions are unique.
3. Of each other anchor goes its context, the bytes of all strings that have it: once a chunk
   for equal bytes (copies with larger ids are covered there and then, so a passage that a
   third of all documents hold sends one context a chunk).
4. Spark deals the contexts by anchor. Where an anchor has one context, its positions have one
   rank. Else the ranks of the contexts' positions are doubled: the pairs (rank at p, rank at
   p+h) are sorted and ranked anew for h = 8, 16 and the rest of the length; a position whose
   rank is unique leaves. Bytes are compared, hashes only deal out work: the result is exact.
5. An anchor that occurs more than HOT times is split: its positions are dealt by the hash of
   their own string.

Defined results: a null text is an empty one; matches never cross documents; a null id comes
after all others, and rows without one take nothing from each other; rows that repeat an id
take nothing from each other; an empty table gives an empty result; other columns are
ignored, whatever their names. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lean, small_batches, small_reads, stored, text_of
from .storage import opened

GRAM = 20
#: Bytes of a chunk, but for a single longer document.
CHUNK = 4_000_000
#: Bytes of text whose anchors make one bucket.
BUCKET = 4_000_000
#: Occurrences beyond which an anchor's positions are dealt one by one.
HOT = 200_000
#: A longer stretch is searched for anchors in parts, which bounds the arrays (positions take 24 bits beside the hash, so 1 << 23 at most).
STRETCH = 1 << 17
#: Bytes that end an Arrow batch: rows of names and of contexts are much larger than documents.
BATCH_BYTES = 2_000_000
_NO_ID = np.iinfo(np.int64).max


def _write_chunk(folder: str, parts: list[bytes]) -> str:
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    name = f"{root}/{uuid.uuid4().hex}.zst"
    with system.open_output_stream(name, compression=None) as out:
        out.write(zstandard.ZstdCompressor(level=3).compress(b"".join(parts)))
    return name


def _read_chunk(name: str) -> np.ndarray:
    system, path = opened(name)
    with system.open_input_stream(path, compression=None) as file:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read()), np.uint8)


def _chunks(folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk; a third column of the batches, if there is one, goes along document by document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, carried, size = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            start = np.cumsum([0, *map(len, parts)])
            columns = [pa.array([_write_chunk(folder, parts)]), pa.array([ids], pa.list_(pa.int64())), pa.array([start], pa.list_(pa.int64()))]
            if carried:
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(carried)))
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "start", "carried"][: len(columns)])

        for batch in batches:
            extra, first = (batch.column(2) if batch.num_columns > 2 else None), 0
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = text.as_py().encode("utf-8")
                if ids and size + len(data) > most:
                    if extra is not None:
                        carried.append(extra.slice(first, at - first))
                    yield flushed()
                    ids, parts, carried, size, first = [], [], [], 0, at
                ids.append(doc)
                parts.append(data)
                size += len(data)
            if extra is not None:
                carried.append(extra.slice(first))
        if ids:
            yield flushed()

    return cut


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _eights(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from every position as a number."""
    return np.ndarray((max(0, len(data) - 7),), order, np.ascontiguousarray(data), strides=(1,))


def anchors(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings within documents: anchor, hash, first and last position of every run of strings with one anchor."""
    out: list[list] = [[], [], [], []]
    wide = length - GRAM + 1
    for base in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[base : base + STRETCH + length - 1]
        e = _eights(part)
        n = len(part) - GRAM + 1
        x = _mix(e[:n] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(e[8 : n + 8]) ^ (e[GRAM - 8 : n + GRAM - 8] * np.uint64(0xC2B2AE3D27D4EB4F)))
        low = (x & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        done = 1
        while 2 * done <= wide:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if wide > done:
            low = np.minimum(low[: len(low) - (wide - done)], low[wide - done :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        p = np.arange(len(at))
        # the string from p lies within one document
        inside = np.zeros(len(at) + 1, np.int32)
        first, last = np.clip(start[:-1] - base, 0, len(at)), np.clip(start[1:] - length + 1 - base, 0, len(at))
        fits = last > first
        np.add.at(inside, first[fits], 1)
        np.add.at(inside, last[fits], -1)
        good = np.cumsum(inside[:-1]) > 0
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
        edge[first[fits]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(at)) - 1
        begin, end = begin[good[begin]], end[good[begin]]
        out[0].append(at[begin] + base)
        out[1].append(x[at[begin]])
        out[2].append(p[begin] + base)
        out[3].append(p[end] + base)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out[0]]), np.concatenate([empty.astype(np.uint64), *out[1]]), np.concatenate([empty, *out[2]]), np.concatenate([empty, *out[3]])


def _split(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of the runs of a sorted array."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(key[a]), a, b


def _named(length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors' hashes (48 bits) and numbers in their chunk, by bucket."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, start in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, h, _, _ = anchors(_read_chunk(chunk), start.values.to_numpy(), length)
                bucket = (h >> np.uint64(16)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rows: list[list] = [[], [], [], []]
                for b, i, j in _split(bucket[order]):
                    some = order[i:j]
                    rows[0].append(b)
                    rows[1].append(chunk)
                    rows[2].append((h[some] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                    rows[3].append(np.diff(some, prepend=0).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "names", "numbers"])

    return name


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, from rows in the order of their buckets."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _repeated(batches, limit)


def _repeated(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The anchors, by chunk, whose hash occurs twice or more; those beyond the limit are hot."""
    for rows in _by_bucket(batches):
        raw = [np.frombuffer(r["names"], np.uint8).reshape(-1, 6) for r in rows]
        names = np.zeros((sum(map(len, raw)), 8), np.uint8)
        names[:, :6] = np.concatenate(raw)
        _, where, count = np.unique(names.view("<u8").ravel(), return_inverse=True, return_counts=True)
        times, at = count[where], 0
        out: list[list] = [[], [], []]
        for r, part in zip(rows, raw, strict=True):
            some = times[at : at + len(part)]
            at += len(part)
            numbers = np.cumsum(np.frombuffer(r["numbers"], "<u4"))[some > 1].astype("<u4")
            if len(numbers):
                for column, value in zip(out, (r["chunk"], numbers.tobytes(), (some[some > 1] > limit).tobytes()), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "numbers", "hot"])


_CONTEXTS = "bucket long, chunk string, name array<long>, size array<int>, contexts binary, doc array<long>, of array<int>, at array<int>"
_CONTEXT_TYPES = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
_CONTEXT_NAMES = ["bucket", "chunk", "name", "size", "contexts", "doc", "of", "at"]


def _parted(row: dict) -> list[bytes]:
    """The contexts of a row, which go together and compressed."""
    if not row["size"]:
        return []
    whole = zstandard.ZstdDecompressor().decompress(row["contexts"])
    ends = np.cumsum(row["size"]).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _contexts(length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By bucket and chunk: contexts with their smallest document and its places; and, without contexts, places covered within the chunk.

    A row without contexts has pairs in ``at``: the first and the last position of covered strings.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for row in batch.to_pylist():
                data, start = _read_chunk(row["chunk"]), np.array(row["start"])
                ids = np.array([_NO_ID if d is None else d for d in row["ids"]], np.int64)
                _, h, first, last = anchors(data, start, length)
                which = np.concatenate([np.frombuffer(s["numbers"], "<u4") for s in row["shared"]]).astype(np.int64)
                hot = np.concatenate([np.frombuffer(s["hot"], bool) for s in row["shared"]])
                name, lo, hi = h[which], first[which], last[which]
                if hot.any():  # one string each
                    many = (hi - lo + 1)[hot]
                    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[hot], hi[hot], strict=True)])
                    own = np.zeros(len(at), np.uint64)
                    e = _eights(data)
                    for k in (*range(0, length - 8, 8), length - 8):
                        own = _mix(own * np.uint64(0x9E3779B97F4A7C15) ^ e[at + k])
                    assert many.sum() == len(at)
                    name, lo, hi = np.concatenate([name[~hot], own]), np.concatenate([lo[~hot], at]), np.concatenate([hi[~hot], at])
                doc = ids[np.searchsorted(start, lo, side="right") - 1]
                text = data.tobytes()
                least: dict[bytes, int] = {}
                keys = [text[a : b + length] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                for key, d in zip(keys, doc.tolist(), strict=True):
                    if d < least.get(key, _NO_ID + 1):
                        least[key] = d
                covered: list[int] = []
                places: dict[bytes, list[int]] = {}
                names: dict[bytes, int] = {}
                for key, d, n, a, b in zip(keys, doc.tolist(), name.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if d > least[key]:
                        covered += (a, b)
                    else:
                        places.setdefault(key, []).append(a)
                        names[key] = n
                if covered:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((zlib.crc32(row["chunk"].encode()) % buckets, row["chunk"], [], [], b"", [], [], covered), _CONTEXT_TYPES, strict=True)], names=_CONTEXT_NAMES)
                distinct = list(places)
                own = np.fromiter(names.values(), np.uint64, len(names))
                bucket = (own >> np.uint64(16)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rows: list[list] = [[] for _ in _CONTEXT_NAMES]
                for b, i, j in _split(bucket[order]):
                    some = [distinct[k] for k in order[i:j]]
                    of = np.repeat(np.arange(len(some)), [len(places[k]) for k in some])
                    values = (b, row["chunk"], own[order[i:j]].view(np.int64), [len(c) for c in some], packer.compress(b"".join(some)), [least[k] for k in some], of, [a for k in some for a in places[k]])
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _CONTEXT_TYPES, strict=True)], names=_CONTEXT_NAMES)

    return give


def ranks(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix doubling over the contexts' positions: for each string that is not unique its context, place and rank."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    rank = _eights(data, ">u8").astype(np.uint64)  # eight bytes are their own rank
    many = size - length + 1
    where = np.repeat(np.arange(len(contexts)), many)
    alive = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[where]  # strings that may not be unique
    h = 8
    while h < length and len(alive):
        step = min(h, length - h)
        # all positions that some string still needs at this rank: its own, and further ones within it
        need = np.zeros(len(data) + 1, np.int32)
        np.add.at(need, alive, 1)
        np.add.at(need, alive + length - h - step + 1, -1)
        p = np.flatnonzero(np.cumsum(need[:-1]) > 0)
        a, b = rank[p], rank[p + step]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        dense = np.cumsum(new) - 1
        ranked = np.empty(len(p), np.uint64)
        ranked[order] = dense
        rank = np.zeros(len(data), np.uint64)
        rank[p] = ranked
        h += step
        # unique strings leave; ranks of further positions may be those of several places of one string, and stay
        own = rank[alive].astype(np.int64)
        stay = np.bincount(own, minlength=dense[-1] + 1)[own] > 1
        alive, where = alive[stay], where[stay]
    return where, alive - begin[where], rank[alive].astype(np.int64)


def _covered(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By chunk: first and last positions of strings that also start in a smaller document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            least: dict[bytes, int] = {}
            variants: dict[int, set] = {}
            for r in rows:
                r["context"] = _parted(r)
                for n, c, d in zip(r["name"], r["context"], r["doc"], strict=True):
                    if d < least.get(c, _NO_ID + 1):
                        least[c] = d
                    variants.setdefault(n, set()).add(c)
            mixed = [c for some in variants.values() if len(some) > 1 for c in some]
            number = {c: k for k, c in enumerate(mixed)}
            smallest: dict[int, np.ndarray] = {}
            if mixed:
                where, place, rank = ranks(mixed, length)
                docs = np.fromiter((least[c] for c in mixed), np.int64, len(mixed))
                best = np.full(rank.max() + 1 if len(rank) else 0, _NO_ID, np.int64)
                np.minimum.at(best, rank, docs[where])
                for k, i, j in _split(where):
                    smallest[k] = (place[i:j], best[rank[i:j]])
            for r in rows:
                if not r["context"]:
                    out = np.array(r["at"], "<i4").reshape(-1, 2)
                else:
                    found = []
                    for c, a, d in ((r["context"][o], a, r["doc"][o]) for o, a in zip(r["of"], r["at"], strict=True)):
                        if least[c] < d:
                            found.append((a, a + len(c) - length))
                        elif (k := number.get(c)) in smallest:
                            place, best = smallest[k]
                            hit = place[best < d]
                            if len(hit):
                                cut = np.flatnonzero(np.diff(hit) > 1) + 1
                                found += [(a + int(s[0]), a + int(s[-1])) for s in np.split(hit, cut)]
                    out = np.array(found, "<i4").reshape(-1, 2)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]]), pa.array([out.astype("<i4").tobytes()], pa.binary())], names=["chunk", "spans"])

    return find


def _mask(data: np.ndarray, spans: list[bytes], length: int) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int32)
    for s in spans or ():
        pairs = np.frombuffer(s, "<i4").reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1] + length, -1)
    return np.cumsum(change[:-1]) > 0


def _results(length: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """With ``texts``: n_removed, kept and what was carried; else the counts and the digest."""

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, ids, start, spans = (batch.column(k)[r].as_py() for k in range(4))
                data = _read_chunk(chunk)
                gone = _mask(data, spans, length)
                if texts:
                    off = [gone[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
                    kept = [data[a:b][~o].tobytes().decode("utf-8", "ignore") for a, b, o in zip(start[:-1], start[1:], off, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(o.sum()) for o in off], pa.int64()), pa.array(kept, pa.string()), batch.column(4)[r].values], names=["n_removed", "kept", "carried"])
                    continue
                out: list[list] = [[] for _ in range(5)]
                for d, a, b in zip(ids, start[:-1], start[1:], strict=True):
                    off = gone[a:b]
                    n = int(off.sum())
                    spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()) if n else 0
                    for column, value in zip(out, (d, b - a, n, spans, hashlib.sha256(data[a:b][~off].tobytes()).hexdigest()), strict=True):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return result


def _only(column: str) -> Column:
    """The value that one row of a group has."""
    return F.first(column, ignorenulls=True).alias(column)


def _spans(each: DataFrame, length: int, chunk: int, hot: int) -> DataFrame:
    """Chunks (chunk, ids, start, spans, carried) with the spans that go."""
    folder = fresh_path(small_batches(each, BATCH_BYTES).sparkSession, "suffix-chunks")
    carried = [f for f in each.schema if f.name == "carried"]
    kind = "chunk string, ids array<long>, start array<long>" + "".join(f", carried array<{f.dataType.simpleString()}>" for f in carried)
    with small_reads(each.sparkSession):
        chunks = stored(each.mapInArrow(lean(_chunks(folder, chunk)), kind), "suffix-chunks")
    own = chunks.select("chunk", "ids", "start")
    count, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.element_at("start", -1)), F.lit(0))).first()
    buckets, tasks = max(16, size // BUCKET), max(8, count // 8)
    named = own.select("chunk", "start").repartition(tasks).mapInArrow(lean(_named(length, buckets)), "bucket long, chunk string, names binary, numbers binary")
    shared = named.repartition(max(8, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_shared(hot)), "chunk string, numbers binary, hot binary")
    # rows of a chunk meet by grouping, as a join would sort both sides: in each task two arrays of tens of MB for a few rows
    numbers = F.when(F.col("numbers").isNotNull(), F.struct("numbers", "hot"))
    by_chunk = own.unionByName(shared, True).repartition(tasks, "chunk").groupBy("chunk").agg(_only("ids"), _only("start"), F.collect_list(numbers).alias("shared"))
    contexts = by_chunk.where(F.size("shared") > 0).select("chunk", "ids", "start", "shared").mapInArrow(lean(_contexts(length, buckets)), _CONTEXTS)
    covered = contexts.repartition(max(8, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_covered(length)), "chunk string, spans binary")
    # what follows takes little, so that fewer tasks do, each of which makes a file where the result is written
    found = chunks.unionByName(covered, True).repartition(max(8, count // 16), "chunk").groupBy("chunk").agg(*(_only(c) for c in chunks.columns if c != "chunk"), F.collect_list("spans").alias("spans"))
    return found.select("chunk", "ids", "start", "spans", *(f.name for f in carried))


def _checked(length: int) -> None:
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    _checked(length)
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = _spans(each, length, chunk, hot)
    return found.mapInArrow(lean(_results(length, False)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """The rows and columns of docs with what is kept as their text (of characters cut in two the rest goes too); null texts stay null.

    The other columns go along with the chunks, so no text is joined again.
    """
    _checked(length)
    others = [c for c in docs.columns if c != text_col]
    named = [F.col(c).alias(f"c{k}") for k, c in enumerate(others)]
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.struct(F.col(text_col).isNull().alias("none"), *named).alias("carried"))
    found = _spans(each, length, chunk, hot)
    rows = found.mapInArrow(lean(_results(length, True)), f"n_removed long, kept string, carried {each.schema['carried'].dataType.simpleString()}")
    back = {c: F.col(f"carried.c{k}").alias(c) for k, c in enumerate(others)}
    return rows.select(*(back.get(c, F.when(~F.col("carried.none"), F.col("kept")).alias(c)) for c in docs.columns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
