"""Merkle manifest of a dataset: a tree of digests a source, a tree over the sources, and a proof of every row.

A leaf is the sha256 of a row's fields. Leaves are dealt by ranges of (source, id, leaf) into
sorted runs on disk, and a leaf's place in its source is the length of the runs before it, so
a source of any size is numbered without one task seeing it whole. Then level after level is
read back from its Parquet folder and every ARITY consecutive nodes, met by their coordinate
(tree, position div ARITY), become a node of the next folder, which keeps their digests. Each
level is a third of the one below. Proofs come down the same way: the paths of a level are
merged with the level's folder by coordinate and handed to the children, so a path is made once
for all leaves below it, and nothing of a tree is held by the driver but its depth and the root.

Defined results: a null field is ``-``, a null source is a source (the first one), null ids come
first; rows of one id stand in the order of their leaves, so equal rows are leaves of their own
whose order cannot be told; a lone leaf is its source's root, a lone source's root the root; a
row without siblings has the proof of no digests; an empty table gives an empty result and no
root; other columns are ignored, whatever their names. Texts are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Nodes that become one.
ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of paths in one plan; then they are written and read again.
LEVELS_A_PLAN = 4


@dataclass
class Manifest:
    """levels: a table a level, leaves first. tops: tree, level, digest, path of every source's root. root: None if there are no rows."""

    levels: list[DataFrame]
    tops: DataFrame | None
    root: str | None


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(values: list[Column]) -> Column:
    """Sha256 (lowercase hex) of fields: ``-`` for null, else the number of its bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds tree (ascending with the group, nulls first), pos (0-based in the group) and n (the group's size).

    Rows are written in sorted runs of a range each. Of a run only its groups' sizes are added up, by group over its runs.
    """
    sorted_runs = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    runs = stored(sorted_runs, "merkle-runs").withColumn("_run", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1))
    parts = runs.groupBy("_run", *group).agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    lengths = parts.groupBy("_run").agg(F.sum("_c").alias("_len"))  # a row a run
    earlier = lengths.select("_run", F.coalesce(F.sum("_len").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.join(earlier, "_run").withColumn("tree", F.min(F.col("_start") + F.col("_first")).over(own)).withColumn("n", F.sum("_c").over(own)).withColumn("_before", before - F.col("_first"))
    theirs = parts.select(F.col("_run").alias("_r"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), "tree", "n", "_before")
    same = F.col("_run") == F.col("_r")
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return runs.join(theirs, same).withColumn("pos", F.col("_i") + F.col("_before")).drop("_id", "_run", "_i", "_r", "_before", *(f"_g{k}" for k in range(len(group))))


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The leaves (tree, pos, n, digest and others) and the levels above (tree, pos, n, digest, children), each written as it is made."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        joined = runs.withColumn("children", F.transform("run", lambda c: c["digest"]))
        node = F.unhex(F.sha2(F.array_join(F.transform("children", _hex), ""), 256))
        levels.append(stored(joined.select("tree", "pos", F.ceil(F.col("n") / ARITY).alias("n"), node.alias("digest"), "children"), f"{name}-level-{len(levels)}"))
        most = -(-most // ARITY)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """tree, level, digest: the node that each tree ends in."""
    out = None
    for k, level in enumerate(levels):
        one = level.where("n = 1").select("tree", F.lit(k).alias("level"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


#: A step of a path: the digests that go before and after one's own.
STEP = "struct<before: binary, after: binary>"


def _step(children: Column, k: Column) -> Column:
    joined = lambda part: F.aggregate(part, F.unhex(F.lit("")), lambda a, d: F.concat(a, d))
    return F.struct(joined(F.slice(children, F.lit(1), k)).alias("before"), joined(F.slice(children, k + 2, F.lit(ARITY))).alias("after"))


def _parents(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """tree, up, children, path, subroot: the nodes above the leaves (of lone leaves none, children being null) with their own paths."""
    paths = None
    for k in range(len(levels) - 1, 0, -1):
        ends = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
        paths = ends if paths is None else paths.unionByName(ends)
        merged = levels[k].select("tree", "pos", "children").join(paths, ["tree", "pos"])
        if k > 1:
            each = merged.select("tree", "pos", "path", "subroot", "children", F.posexplode("children").alias("k", "child"))
            paths = each.select("tree", (F.col("pos") * ARITY + F.col("k")).alias("pos"), F.concat(F.array(_step(F.col("children"), F.col("k"))), F.col("path")).alias("path"), "subroot")
            if (len(levels) - k) % LEVELS_A_PLAN == 0:
                paths = stored(paths, f"{name}-paths-{k}")
    lone = tops.where("level = 0").select("tree", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<binary>").alias("children"), "path", F.col("digest").alias("subroot"))
    return lone if paths is None else lone.unionByName(merged.withColumnRenamed("pos", "up").select(lone.columns))


def _with_paths(levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The leaves with the path from each to the root, lowest step first, and the root of their tree."""
    leaves = levels[0].withColumn("up", F.floor(F.col("pos") / ARITY)).join(_parents(levels, tops, name), ["tree", "up"])
    own = F.array(_step(F.col("children"), (F.col("pos") % ARITY).cast("int")))
    return leaves.withColumn("path", F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(own, F.col("path")))).drop("up", "children")


def build(docs: DataFrame, group: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, **more: Column) -> Manifest:
    """The trees of a table's rows. ``more``: columns, made from the rows, that the leaves carry along."""
    names = [f"_m{k}" for k in range(len(more))]
    own = docs.select(F.col(group).cast("string").alias("group"), F.col(id_col).alias("id"), F.unhex(digest_of([F.col(f) for f in fields])).alias("digest"), *(c.alias(n) for c, n in zip(more.values(), names, strict=True)))
    # written once, so that cutting the order into ranges does not hash the rows again
    leaves = stored(numbered(stored(own, "merkle-leaves"), ["group"], ["id", "digest"]).withColumnsRenamed(dict(zip(names, more, strict=True))), "merkle-level-0")
    levels = _levels(leaves, "merkle")
    roots = numbered(_tops(levels).withColumnRenamed("tree", "of"), [], ["of", "level", "digest"])
    over = _levels(stored(roots, "merkle-sources-0"), "merkle-sources")
    last = _tops(over).withColumn("path", F.array().cast(f"array<{STEP}>"))
    root = last.select(_hex(F.col("digest"))).first()
    if root is None:
        return Manifest(levels, None, None)
    tops = _with_paths(over, last, "merkle-sources").select(F.col("of").alias("tree"), "level", "digest", "path")
    return Manifest(levels, stored(tops, "merkle-tops"), root[0])


def proofs(manifest: Manifest) -> DataFrame:
    """group, id, leaf, subroot (hex), path and the columns carried along, of every row; without rows nothing."""
    if manifest.root is None:
        none = manifest.levels[0].withColumn("path", F.array().cast(f"array<{STEP}>")).withColumn("subroot", F.col("digest"))
    else:
        none = _with_paths(manifest.levels, manifest.tops, "merkle")
    return none.withColumn("leaf", _hex(F.col("digest"))).withColumn("subroot", _hex(F.col("subroot"))).drop("tree", "pos", "n", "digest")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(_hex(s["before"]), own, _hex(s["after"])), 256))


def proof_digest(path: Column) -> Column:
    """Sha256 of the path's digests, lowest first, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    fields = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    manifest = build(docs, changed=F.when(even & F.col("text").contains("\n"), F.unhex(digest_of(fields))))
    tampered = F.coalesce(_hex(F.col("changed")), F.col("leaf"))
    root = F.lit(manifest.root)
    return (
        proofs(manifest)
        .select(F.col("id").alias("doc_id"), "leaf", "subroot", root.cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(tampered, F.col("path")).alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


_CRC = "list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::ubigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::ubigint)))"
_PART = "case when {0} is null then '-' else concat(octet_length(encode({0}::varchar)), ':', {0}::varchar) end"


def _nodes_sql(name: str, leaves: str) -> str:
    """Nodes of all levels and, of each but the roots, what goes before and after it in its run."""
    frame = "over (partition by level, tree, pos // 3 order by pos rows between {})"
    return f"""{name}(level, tree, pos, n, digest) as (
  {leaves}
  union all
  select level + 1, tree, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by level, tree, pos // 3),
{name}_runs as (select level, tree, pos, digest,
  coalesce(string_agg(digest, '') {frame.format("unbounded preceding and 1 preceding")}, '') as before,
  coalesce(string_agg(digest, '') {frame.format("1 following and unbounded following")}, '') as after from {name} where n > 1)"""


def _walk_sql(name: str, begin: str, nodes: str) -> str:
    """From the leaves up: the digest folded so far and the siblings met."""
    return f"""{name}(row, level, tree, pos, own, met) as (
  {begin}
  union all
  select w.row, w.level + 1, w.tree, w.pos // 3, sha256(concat(r.before, w.own, r.after)), concat(w.met, r.before, r.after)
  from {name} w join {nodes}_runs r using (level, tree, pos))"""


#: Levels are built, and paths folded, by recursion.
OP13_SQL = f"""with recursive
marked as (select *, row_number() over () as row, doc_id is not null and (({_CRC.format("doc_id::varchar")}) & 1) = 1 as even from documents),
hashed as (select *, sha256(concat({", ".join(_PART.format(f) for f in FIELDS)})) as leaf,
  sha256(concat({", ".join(_PART.format("case when even then replace(text, chr(10), '') else text end" if f == "text" else f) for f in FIELDS)})) as changed from marked),
leaves as (select row, doc_id, leaf, changed, dense_rank() over (order by source nulls first) - 1 as tree,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from hashed),
{_nodes_sql("nodes", "select 0, tree, pos, n, leaf from leaves")},
subroots as (select tree, digest, count(*) over () as n from nodes where n = 1),
{_nodes_sql("tops", "select 0, 0, tree, n, digest from subroots")},
root as (select digest from tops where n = 1),
{_walk_sql("inside", "select row, 0, tree, pos, changed, '' from leaves", "nodes")},
below as (select row, tree, arg_max(own, level) as own, arg_max(met, level) as met from inside group by row, tree),
{_walk_sql("outside", "select row, 0, 0, tree, own, met from below", "tops")},
ends as (select row, arg_max(own, level) as own, arg_max(met, level) as met from outside group by row)
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(e.met) as proof_sha256, e.own as folded_root, e.own = r.digest as verified
from leaves l join subroots s using (tree) join ends e using (row) cross join root r"""
