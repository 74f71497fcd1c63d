"""Best-fit packing by a plan over the length histogram.

1. Every document becomes pieces of at most ``capacity`` tokens (only longer documents
   are cut); the pieces' lengths and checksums are written, not their ids.
2. The histogram of lengths (at most ``capacity`` rows, whatever the input) is packed on
   the driver, longest first, each length as a whole number of items: they go to the open
   sequences with the least room that fits, else to new ones. The plan is a list of slot
   ranges: items ``lo`` to ``hi`` of a length go to consecutive sequences at one offset.
3. Pieces get their rank within their length (counted by salt, so a length that holds a
   third of all pieces is split), and take their slot by a join on length and block of ranks.

Defined results: a null text is an empty document, which is the end id alone; a null id
is kept; repeated rows are packed each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import small_batches, stored, text_of

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Ranks of a length are counted in this many parts.
SALTS = 256
#: Slots are joined by blocks of this many ranks.
RANKS = 4096


def _cut(vocabulary: str, capacity: int, end: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): item lo+k of that length goes to sequence first+k, for lo+k < hi."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: (first sequence, how many)
    slots, opened = [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, n: int, free: int) -> None:
            nonlocal rank, left
            slots.append((length, rank, rank + n, first, capacity - free))
            rank, left = rank + n, left - n
            room[free - length].append((first, n))

        free = length
        while left and free <= capacity:
            if not room[free]:
                free += 1
                continue
            first, n = room[free].pop()
            if n > left:
                room[free].append((first + left, n - left))
                n = left
            put(first, n, free)
            free = length  # what is left in those sequences may fit another one best
        each = capacity // length
        for bins, deep in ((left // each, each), (left % each and 1, left % each)):
            if bins:
                for k in range(deep):
                    slots.append((length, rank, rank + bins, opened, k * length))
                    rank += bins
                room[capacity - deep * length].append((opened, bins))
                opened += bins
    return slots


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = stored(texts.mapInArrow(_cut(vocabulary, capacity, end_id.to_bytes(4, "little")), _PIECES), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    slots = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    blocks = spark.createDataFrame(slots, "length int, lo long, hi long, first long, offset long").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / RANKS), F.floor((F.col("hi") - 1) / RANKS))))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    local = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k") - 1).withColumn("block", F.floor(F.col("rank") / RANKS))
    placed = ranked.join(blocks, ["length", "block"]).where("rank >= lo and rank < hi")
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
