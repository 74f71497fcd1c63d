"""SimHash near-duplicates, with pigeonring filtering before the full Hamming check.

A fingerprint is a ring of bits, cut into segments. If two fingerprints differ in at most
t of the bits over m segments, then some chain of consecutive segments starts on the ring
whose first l segments differ in at most floor(l * t / m) bits together, for every l. Keys
carry the first two segments of the chain: the first exact, the second with every change
that the budget of two segments allows. Fingerprints that share a key are candidates; the
full check follows.

Fingerprints may be several 64-bit words wide. The operator's other form, ``similar_sets``,
links texts of a Jaccard similarity: its candidates pass ``chained``, the same filter with a
word as a segment, before their sets decide.

Candidates under one key are taken as pairs only for short runs. A longer run, such as a
group of thousands of near copies, is searched breadth first: a member is compared with
those not reached yet, which gives the run's components without listing its pairs. Runs
of over BLOCK members are dealt out as pairs of blocks.

Defined results: a null text is an empty one; texts without words have fingerprint zero
and are linked like any other; a row without id links nothing and has no component;
repeated rows share a fingerprint and so a component; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_of
from .components import components

#: Runs up to this length are listed as pairs; longer ones are searched as groups.
SHORT = 12
#: Members of a group's block.
BLOCK = 20_000


@dataclass(frozen=True)
class Ring:
    """How fingerprints are made and compared.

    shingle: words of a shingle. words: 64-bit words of a fingerprint. limit: differing bits that still link.
    keys: (shift, first, second) of each key in bits: the chain starts at that bit of the ring, its first segment
    is exact, in its second ``flips`` bits (0 or 1) may differ.
    """

    shingle: int
    words: int
    limit: int
    keys: tuple[tuple[int, int, int], ...]
    flips: int


def contract_ring() -> Ring:
    """Four words, 64 bits, at most 4 differing: five segments, so chains of budgets 0, 1, ...: complete."""
    sizes = (13, 13, 13, 13, 12)
    starts = np.cumsum((0, *sizes[:-1])).tolist()
    return Ring(4, 1, 4, tuple((starts[i], sizes[i], sizes[(i + 1) % 5]) for i in range(5)), 1)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _more(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words of the shingles: splitmix64 of hash and word number."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hash of the shingle at each place; a text of fewer words is one shingle, and of none has none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def chained(differ: list[Column], limit: int | Column) -> Column:
    """Pigeonring filter and full check in one: from some segment on, the differing bits of the chain's first l segments
    stay within l shares of the limit, for every l up to the whole ring. No two within the limit fail it."""
    m = len(differ)
    within = lambda start, n: sum((differ[(start + i) % m] for i in range(n)), F.lit(0)) * m <= (limit if isinstance(limit, Column) else F.lit(limit)) * n
    chain = lambda start: reduce(lambda x, y: x & y, (within(start, n) for n in range(1, m + 1)))
    return reduce(lambda x, y: x | y, (chain(start) for start in range(m)))


def fingerprint_of(h: np.ndarray, words: int, first: int = 0) -> np.ndarray:
    """The words of a set or sequence of hashes, from hash word ``first`` on."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(h) else 0):
        bits = np.unpackbits((_more(h, k + first) if k + first else h).view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
        out[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int32) > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str, shingle: int, words: int = 1) -> np.ndarray:
    """The fingerprint's words (unsigned 64-bit)."""
    h = shingle_hashes(text, shingle)
    return fingerprint_of(h, words)


def _fingerprints(shingle: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, words).view(np.int64) for t in batch.column(1)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * words, pa.int32()), flat)], names=["doc_id", "w"])

    return of


def fingerprints(docs: DataFrame, ring: Ring, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w: the words of each document's fingerprint, as signed longs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_fingerprints(ring.shingle, ring.words), "doc_id long, w array<long>")


def _cut(at: int, size: int, words: int) -> Column:
    """``size`` bits of the ring from bit ``at`` on."""
    bits, at = 64 * words, at % (64 * words)
    word, low = divmod(at, 64)
    value = F.shiftrightunsigned(F.col("w")[word], low)
    if low + size > 64:
        value = value.bitwiseOR(F.shiftleft(F.col("w")[(word + 1) % (bits // 64)], 64 - low))
    return value.bitwiseAND(F.lit((1 << size) - 1))


def _keys(ring: Ring) -> Column:
    out = []
    for number, (at, first, second) in enumerate(ring.keys):
        own = F.shiftleft(_cut(at, first, ring.words), second).bitwiseOR(_cut(at + first, second, ring.words)).bitwiseOR(F.lit(number << (first + second)))
        out.append(own)
        # one side of a differing bit has it unset: that side's key with the bit set is the other's own key
        out += [F.when(own.bitwiseAND(F.lit(1 << b)) == 0, own.bitwiseOR(F.lit(1 << b))) for b in range(second if ring.flips else 0)]
    return F.array_compact(F.array(*out)) if ring.flips else F.array(*out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys: pairs of short runs, and (key, block, block) groups of long ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("run", pa.string())])
    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def found(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        short = np.repeat(size <= SHORT, size)
        left, right = [], []
        for lag in range(1, SHORT):
            hit = np.flatnonzero((key[lag:] == key[:-lag]) & short[lag:])
            left.append(node[hit])
            right.append(node[hit + lag])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.string())], schema=schema)
        for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            members = np.unique(node[s : s + n])
            blocks = [members[i : i + BLOCK] for i in range(0, len(members), BLOCK)]
            for i, x in enumerate(blocks):
                for j in range(i, len(blocks)):
                    if j > i or len(blocks) == 1:
                        both = x if j == i else np.concatenate([x, blocks[j]])
                        yield pa.RecordBatch.from_arrays([pa.array(both), pa.nulls(len(both), pa.int64()), pa.array([f"{key[s]}.{i}.{j}"] * len(both))], schema=schema)

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        if len(key) and key[0] != key[-1]:
            at = int(np.searchsorted(key, key[-1]))
            yield from found(key[:at], node[:at])
            key, node = key[at:], node[at:]
    yield from found(key, node)


def group_edges(nodes: np.ndarray, w: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the root of each component of the group's graph: links of at most ``limit`` differing bits."""
    left, right = [], []
    open_ = np.arange(len(nodes))
    while len(open_):
        root, frontier, open_ = open_[0], [open_[0]], open_[1:]
        while frontier and len(open_):
            near = np.bitwise_count(w[open_] ^ w[frontier.pop()]).sum(axis=1) <= limit
            reached = open_[near]
            left.append(nodes[reached])
            right.append(np.full(len(reached), nodes[root]))
            frontier += reached.tolist()
            open_ = open_[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(nodes: DataFrame, ring: Ring) -> DataFrame:
    """a, b: links between the nodes (node, w) that join up whatever the ring's limit and keys join up."""
    limit = ring.limit
    keyed = nodes.select(F.explode(_keys(ring)).alias("key"), "node").repartition("key").sortWithinPartitions("key")
    runs = stored(keyed.mapInArrow(_runs, "a long, b long, run string"), "simhash-runs")
    pairs = runs.where("run is null").select("a", "b").distinct()
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("w").alias("w_" + n))
    differ = sum((F.bit_count(F.col("w_a")[k].bitwiseXOR(F.col("w_b")[k])) for k in range(ring.words)), F.lit(0))
    near = pairs.join(at("a"), "a").join(at("b"), "b").where(differ <= limit).select("a", "b")

    def searched(group):
        import pandas as pd

        a, b = group_edges(group["node"].to_numpy(), np.stack(group["w"].to_numpy()).view(np.uint64), limit)
        return pd.DataFrame({"a": a, "b": b})

    groups = runs.where("run is not null").select(F.col("a").alias("node"), "run").join(nodes, "node")
    return near.unionByName(groups.groupBy("run").applyInPandas(searched, "a long, b long"))


def near_duplicates(docs: DataFrame, ring: Ring, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w, component_id: the smallest id that links lead to."""
    each = stored(fingerprints(docs, ring, id_col, text_col), "simhash")
    nodes = stored(each.where("doc_id is not null").groupBy("w").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    joined = components(stored(links(nodes, ring), "simhash-links"))
    labelled = nodes.join(joined, "node", "left").select("w", F.least("node", F.coalesce("component", "node")).alias("component_id"))
    return each.join(labelled, "w", "left").select("doc_id", "w", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), contract_ring())
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("w")[0])), 16, "0").alias("fingerprint"), "component_id")
