"""Token counts without token ids.

1. Texts are cut into pre-tokens once. Each batch of documents becomes a block, which holds
   the distinct pre-tokens and, for each document, their positions in that list with their
   frequencies. The blocks are written to shared storage.
2. The blocks' pre-tokens are sorted, and the library counts the pieces of every distinct
   pre-token of the corpus once, where its run begins. A pre-token occurs once a block,
   however many documents hold it, so there are no hot keys.
3. Those counts are joined to their blocks, and a document's count is the sum of frequency
   times pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id is kept;
repeated rows are counted each; an empty table gives an empty result; other columns
are ignored, whatever their names. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenizer
from .common import stored, text_of

_BLOCKS = "block long, doc_id array<long>, n_bytes array<long>, start array<int>, entries binary, words array<string>"
#: Documents of one block hold this many characters at most, but for a single longer one.
BLOCK_CHARS = 24_000_000
#: Counted pre-tokens that are put together before they go to their blocks.
HELD = 1_000_000


def packed(*columns: np.ndarray) -> bytes:
    """Columns of small numbers, byte by byte of equal weight, compressed."""
    stacked = np.stack([c.astype("<u4") for c in columns])
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(stacked.reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes, columns: int = 2) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(plain.T).view("<u4").reshape(columns, -1).astype(np.int64)


def _blocks(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre, part, n = PreTokenizer(path), TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), *((c, pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("start", pa.int32()))), ("entries", pa.binary()), ("words", pa.list_(pa.string()))])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                place: dict[str, int] = {}
                ids, sizes, start, piece, freq, chars = [], [], [0], [], [], 0
                while at < batch.num_rows and (not ids or chars < BLOCK_CHARS):
                    text = batch.column(1)[at].as_py()
                    counted = Counter(pre(text))
                    at_place = np.fromiter((place.setdefault(w, len(place)) for w in counted), np.int64, len(counted))
                    order = np.argsort(at_place)
                    piece.append(np.diff(at_place[order], prepend=0))
                    freq.append(np.fromiter(counted.values(), np.int64, len(counted))[order])
                    ids.append(batch.column(0)[at].as_py())
                    sizes.append(len(text.encode()))
                    start.append(start[-1] + len(counted))
                    chars += len(text)
                    at += 1
                row = [[(part << 32) + n], [ids], [sizes], [start], [packed(np.concatenate(piece), np.concatenate(freq))], [list(place)]]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return cut


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of their words: by block, packed positions and pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, word, pieces = PreTokenizer(path), None, 0
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            block, pos, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((pos, block))
            block, pos, n = block[order], pos[order], n[order]
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            rows = [(int(block[i]), packed(np.diff(pos[i:j], prepend=0), n[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "counts"])

        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                if w != word:
                    word, pieces = w, len(pre.encode([w])[0])
                out.append(pieces)
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), np.array(out, np.int64)))
            size += len(out)
            if size > HELD:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    return count


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids, sizes, start = (batch.column(c)[r].values for c in range(3))
            at = start.to_numpy()
            delta, freq = unpacked(batch.column(3)[r].as_py())
            # places add up within each document
            whole = np.concatenate([[0], np.cumsum(delta)])
            piece = whole[1:] - np.repeat(whole[at[:-1]], np.diff(at))
            of = np.zeros(int(piece.max()) + 1 if len(piece) else 1, np.int64)
            for part in batch.column(4)[r].as_py():
                step, n = unpacked(part)
                of[np.cumsum(step)] = n
            total = np.concatenate([[0], np.cumsum(of[piece] * freq)])
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": sizes, "n_tokens": pa.array(total[at[1:]] - total[at[:-1]], pa.int64())})


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document. ``vocabulary``: path of a word-end BPE file, as every worker sees it."""
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    blocks = stored(cut.mapInArrow(_blocks(vocabulary), _BLOCKS), "token-blocks")
    words = blocks.select(F.posexplode("words").alias("pos", "word"), "block").select("word", "block", "pos").repartition("word").sortWithinPartitions("word")
    counted = words.mapInArrow(_pieces(vocabulary), "block long, counts binary").groupBy("block").agg(F.collect_list("counts").alias("counts"))
    joined = blocks.drop("words").join(counted, "block", "left")
    counts = F.coalesce("counts", F.array().cast("array<binary>"))
    return joined.select("doc_id", "n_bytes", "start", "entries", counts.alias("counts")).mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)
