"""SimHash near-duplicates at a Jaccard similarity: no similar pair is lost, and sets decide.

Candidates come first from the operator's own ring (``ringed``): chains of two segments of the
fingerprint's first word as keys, complete for 4 differing bits of 64, with its Hamming check.
But two sets of shingles at the similarity t differ in up to 19 of 100 bits of their
fingerprints (``DIFFER``): no chain of segments of them is both a selective key and sure to be
shared. So the rest, what is similar and further apart, has candidates from the sets: a set of
n shingles that is similar to another shares ceil(t * n) of its shingles with it, so in any one
order of all shingles the first n - ceil(t * n) + 1 of both have one in common: those are a
set's keys. The order puts shingles that a sample shows to be common last, which keeps runs of
a key short; it changes the work and not the result.

All candidates then pass the full Hamming check on fingerprints of four words
(``simhash.chained``, with ``LIMITS``). What passes is decided by the sets made from the texts,
in two rounds: each set with one candidate first, the nearest of the ring's or else of the
others, then only candidates whose two sets no link has joined yet.

Of a run of over SHORT sets only neighbours are taken as pairs at first. A run whose sets
are then all in one component can link nothing more. In any other, sets that the filter lets
be similar to one of another component are chained (a forest, not their pairs), and what the
chains of all runs join up is a family. A family's texts meet once and are searched breadth
first, and large families in pairs of blocks. Nothing is capped.

Defined results: a null text is an empty one; texts without words are alike; sets are
compared by 63-bit hashes of their shingles; rows of one id with other texts are rows of
their own; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of
from .components import components
from .simhash import chained, contract_ring, fingerprint_of, shingle_hashes
from .simhash import links as ring_links

#: Runs up to this length are listed as pairs.
SHORT = 12
#: Neighbours at either side that a member of a longer run is paired with at first.
NEAR = 2
#: Members of a run's block; of a family's block also the shingles.
BLOCK, BLOCK_SHINGLES = 4_000, 1_500_000
#: One text in so many is looked at for common shingles; at most COMMON of them are put last.
SAMPLE, COMMON = 20, 100_000
#: Slots of the filter that texts pass before they are joined: half a megabyte of bits.
SLOTS = 1 << 22
#: Words of a fingerprint.
WORDS = 4
#: The largest chance that a bit of two fingerprints differs, of sets of 0.8 or more: of small sets (4 shingles in one of 5), and of LARGE ones.
DIFFER, LARGE = (0.1875, 0.1582), 20
#: Differing bits of 256 that two small or large sets of this similarity exceed once in 10^10 or less; unlike sets have some 128.
LIMITS = (96, 80)
#: Hashes of sets that a worker holds while it decides pairs.
HELD = 2_000_000


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order; of no words the empty set."""
    return np.unique(shingle_hashes(text, shingle) >> np.uint64(1))


def _least(n, similarity: float):
    """How many of its n shingles a set shares at least with a similar one."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(similarity * n - 1e-9))


def similar(common, n_a, n_b, similarity: float):
    return common * (1 + similarity) >= similarity * (n_a + n_b) - 1e-9


def keys_of(own: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(t * n) + 1 shingles, in order; those in ``common`` (ordered) have the top bit set and so come last."""
    if len(own) and len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.sort(own | (late.astype(np.uint64) << np.uint64(63)))
    return own[: len(own) - _least(len(own), similarity) + 1]


def row_key(text_col: str = "text") -> Column:
    """With the id it tells rows of one id apart."""
    return F.xxhash64(text_of(text_col))


def _sets(shingle: int, similarity: float, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(arrays: list[np.ndarray]) -> pa.Array:
        flat = pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), flat)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                columns = [batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), lists([keys_of(s, common, similarity) for s in sets]), lists([fingerprint_of(s, WORDS, 1) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "n", "keys", "w"])

    return of


def _hashes(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["h"])

    return of


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order: pairs, and the members of long runs as groups of one or two blocks."""
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
            hit = np.flatnonzero((key[lag:] == key[:-lag]) & (short[lag:] | (lag <= NEAR)))
            left.append(node[hit])
            right.append(node[hit + lag])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.string())], schema=schema)
        for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            members = node[s : s + n]
            blocks = [members[i : i + BLOCK] for i in range(0, n, BLOCK)]
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


def _asked(slots: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(slots, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy() & (SLOTS - 1)
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    return of


def _decided(shingle: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def set_of(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if (found := known.get(node)) is None:
                if held > HELD:
                    known.clear()
                    held = 0
                known[node] = found = shingle_set(text.as_py(), shingle)
                held += len(found)
            return found

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = set_of(a, ta), set_of(b, tb)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return of


def within(w: np.ndarray, n: np.ndarray, u: int, some: np.ndarray, similarity: float) -> np.ndarray:
    """Of ``some`` (numbers) those whose size and fingerprint let them be similar to u."""
    size = n[some]
    limit = np.where(np.minimum(size, n[u]) < LARGE, *LIMITS)
    return some[(np.bitwise_count(w[some] ^ w[u]).sum(axis=1) <= limit) & (size >= similarity * n[u] - 1e-9) & (similarity * size <= n[u] + 1e-9)]


def forest(nodes: np.ndarray, component: np.ndarray, n: np.ndarray, w: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join up whatever pairs of two components the filter lets be similar."""
    open_ = np.ones(len(nodes), bool)
    left, right = [], []
    for first in range(len(nodes)):
        if not open_[first]:
            continue
        open_[first] = False
        frontier = [first]
        while frontier:
            u = frontier.pop()
            reached = within(w, n, u, np.flatnonzero(open_ & (component != component[u])), similarity)
            open_[reached] = False
            left.append(np.full(len(reached), nodes[u]))
            right.append(nodes[reached])
            frontier += reached.tolist()
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def group_edges(nodes: np.ndarray, component: np.ndarray, w: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join up the group's similar sets, as far as ``component`` does not already."""
    n = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(n)[:-1])
    mine = np.zeros(int(max((c.max() for c in codes if len(c)), default=0)) + 1, bool)
    open_ = np.ones(len(sets), bool)
    left, right = [], []
    for first in range(len(sets)):
        if not open_[first]:
            continue
        frontier = np.flatnonzero(open_ & (component == component[first])).tolist()
        open_[frontier] = False
        while frontier:
            u = frontier.pop()
            some = within(w, n, u, np.flatnonzero(open_), similarity)
            if not len(some):
                continue
            mine[codes[u]] = True
            common = np.array([np.count_nonzero(mine[codes[v]]) for v in some.tolist()])
            mine[codes[u]] = False
            reached = some[similar(common, n[u], n[some], similarity)]
            left.append(np.full(len(reached), nodes[u]))
            right.append(nodes[reached])
            if len(reached):
                more = np.flatnonzero(open_ & np.isin(component, component[reached]))
                open_[more] = False
                frontier += more.tolist()
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def near_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b, late, d: of the candidates (a, b, late) those that sizes and the full Hamming check leave, with their differing bits."""
    at = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias("n_" + x), F.col("w").alias("w_" + x))
    both = pairs.join(at("a"), "a").join(at("b"), "b").where(f"least(n_a, n_b) >= {similarity} * greatest(n_a, n_b) - 1e-9")
    differ = [f"d{k}" for k in range(WORDS)]
    both = both.select("a", "b", "late", F.when(F.least("n_a", "n_b") < LARGE, LIMITS[0]).otherwise(LIMITS[1]).alias("limit"), *(F.bit_count(F.col("w_a")[k].bitwiseXOR(F.col("w_b")[k])).alias(d) for k, d in enumerate(differ)))
    return both.where(chained([F.col(d) for d in differ], F.col("limit"))).select("a", "b", "late", F.expr("+".join(differ)).cast("int").alias("d"))


def ringed(nodes: DataFrame) -> DataFrame:
    """a, b: pairs that join up all nodes whose fingerprints' first words differ in at most 4 bits, by pigeonring keys."""
    found = ring_links(nodes.select("node", F.slice("w", 1, 1).alias("w")), contract_ring())
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b: links between nodes (distinct sets) that join up all pairs of at least this similarity."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    runs = stored(keyed.mapInArrow(_candidates, "a long, b long, run string"), "similar-runs")
    listed = ringed(nodes).withColumn("late", F.lit(0)).unionByName(runs.where("run is null").select("a", "b", F.lit(1).alias("late")))
    listed = listed.groupBy("a", "b").agg(F.min("late").alias("late"))
    pairs = stored(near_pairs(listed, nodes, similarity), "similar-pairs", 1 + runs.count() // 50_000)
    many = pairs.count()
    few = 1 + many // 100_000

    def text_by(chosen: DataFrame) -> DataFrame:
        wanted = stored(nodes.join(chosen, "node", "left_semi").select("node", "doc_id", "row"), "similar-wanted", few)
        slot = F.col("row").bitwiseAND(F.lit(SLOTS - 1))
        bits = np.zeros(SLOTS, bool)
        for batch in wanted.select(slot.cast("int").alias("slot")).distinct().toArrow().to_batches():  # SLOTS at most
            bits[batch.column(0).to_numpy()] = True
        asked = texts.mapInArrow(_asked(np.packbits(bits, bitorder="little").tobytes()), "doc_id long, row long, text string")
        return asked.join(wanted, ["doc_id", "row"]).dropDuplicates(["node"]).select("node", "text")

    own = stored(text_by(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()), "similar-texts", 1 + many // 5_000)

    def decided(some: DataFrame) -> DataFrame:
        at = lambda x: own.select(F.col("node").alias(x), F.col("text").alias("t_" + x))
        both = some.join(at("b"), "b").join(at("a"), "a").select("a", "b", "t_a", "t_b")
        return stored(both.mapInArrow(_decided(shingle, similarity), "a long, b long"), "similar-links", 1 + many // 3_000)

    # each set with its nearest candidate, the ring's first, then what these links have not joined
    order = F.struct("late", "d", "a", "b").alias("p")
    ends = pairs.select(F.col("a").alias("x"), order).unionByName(pairs.select(F.col("b").alias("x"), order))
    nearest = stored(ends.groupBy("x").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct(), "similar-nearest", few)
    near = decided(nearest)
    in_one = components(near)
    of = lambda x: in_one.select(F.col("node").alias(x), F.col("component").alias("c_" + x))
    rest = pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    near = near.unionByName(decided(rest.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")))

    groups = runs.where("run is not null").select(F.col("a").alias("node"), "run")
    if groups.isEmpty():
        return near
    joined = components(near)
    groups = groups.join(joined, "node", "left").select("node", "run", F.coalesce("component", "node").alias("component"))
    # of runs with the same members one is enough
    told = groups.groupBy("run").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.expr("bit_xor(node)").alias("p"), F.expr("bit_xor(xxhash64(node))").alias("q"))
    mixed = told.where("x <> y").groupBy("size", "p", "q").agg(F.min("run").alias("run")).select("run")
    groups = groups.join(mixed, "run", "left_semi").join(nodes.select("node", "n", "w"), "node")

    def frame(edges):
        import pandas as pd

        return pd.DataFrame({"a": edges[0], "b": edges[1]})

    def words(group) -> np.ndarray:
        return np.stack(group["w"].to_numpy()).view(np.uint64)

    def chains(group):
        return frame(forest(group["node"].to_numpy(), group["component"].to_numpy(), group["n"].to_numpy(), words(group), similarity))

    def searched(group):
        return frame(group_edges(group["node"].to_numpy(), group["component"].to_numpy(), words(group), [shingle_set(t, shingle) for t in group["text"]], similarity))

    edges = stored(groups.groupBy("run").applyInPandas(chains, "a long, b long").distinct(), "similar-chains")
    if edges.isEmpty():
        return near
    members = components(edges).withColumnRenamed("component", "family").join(nodes.select("node", "n", "w"), "node")
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES, F.lit(1.0))).alias("blocks"))
    placed = members.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a block meets every other one; a single block itself
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("own"))))
    placed = placed.withColumn("other", other).select("node", "w", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    placed = placed.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    with_texts = placed.join(text_by(members.select("node")), "node")
    return near.unionByName(with_texts.groupBy("family", "i", "j").applyInPandas(searched, "a long, b long"))


def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row: of each group of similar texts the row of the smallest id (of its texts, if several, the one of the smallest row key).

    ``similarity`` is 0.8 or more: LIMITS are made for it.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the fingerprints' limit holds for similarities of 0.8 to 1")
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("row"), text_of(text_col).alias("text")).where("doc_id is not null")
    seen = texts.where(F.pmod(F.col("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_hashes(shingle), "h long").groupBy("h").count().where("count >= 3")
    common = np.sort(np.array([r.h for r in seen.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64).view(np.uint64))
    each = texts.mapInArrow(_sets(shingle, similarity, common), "doc_id long, row long, node long, n int, keys array<long>, w array<long>")
    # one row for each node: copies leave within their partitions first
    first = F.min(F.struct("doc_id", "row", "n", "keys", "w")).alias("x")
    nodes = stored(each.groupBy("node").agg(first).select("node", "x.*"), "similar-nodes")
    joined = components(stored(links(nodes, texts, similarity, shingle), "similar-all"))
    whole = nodes.select("node", "doc_id", "row").join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("doc_id", "row")).alias("least"))
    return whole.select("least.doc_id", "least.row")
