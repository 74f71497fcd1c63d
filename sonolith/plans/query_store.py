"""The write side: tables by snapshots, datasets that are built, appended to and compacted, files cut by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dataset
from ..operators import registry
from ..operators.fragment import Windows
from ..sources import files, signals
from ..store import Store, work_dir
from .registry import query


@query("""select vec_id, label, case when label < 5 then round(list_max(embedding)::double, 6) end as peak,
case when label >= 5 then round(list_sum([v::double * v::double for v in embedding]), 6) end as energy, 4::bigint as version, 2::bigint as n_folders from embeddings""")
def store_roundtrip(spark, d):
    """A table built, appended to twice with other columns, and compacted: no column and no row is lost."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    store = Store(spark, work_dir(spark, "store"))
    square = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    parts = [e.where("label < 5").select("vec_id", "label", F.round(F.array_max("embedding").cast("double"), 6).alias("peak"))]
    parts += [e.where(f"label {which}").select("vec_id", "label", F.round(square, 6).alias("energy")) for which in ("between 5 and 7", "> 7")]
    for rows in parts:
        change = store.change("append")
        change.append("vectors", rows)
        change.commit({})
    change = store.change("compact")
    change.replace("vectors", store.read("vectors", change.base).repartitionByRange("vec_id").sortWithinPartitions("vec_id"))
    change.commit({"compacted": True})
    left = len(store.vacuum(keep=2)), store.snapshot()["version"]
    assert left[0] == 0  # the snapshot before still names its three folders
    return store.read("vectors").select("vec_id", "label", "peak", "energy", F.lit(left[1]).cast("long").alias("version"), F.lit(len(store.versions())).cast("long").alias("n_folders"))


def written(spark, d) -> str:
    """A folder of wave files: L<label>/B<block>.wav holds the label's vectors of a hundred ids, one after the other."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    name = F.concat(F.lit("L"), F.col("label"), F.lit("/B"), F.floor(F.col("vec_id") / 100), F.lit(".wav"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]))
    rows = e.groupBy(name.alias("name")).agg(joined.alias("waveform"))  # a hundred vectors at most
    root = work_dir(spark, "waves")
    files.write_wave(rows, root, 8000)
    return root


_LEVELS = "[floor(v::double * 32768) / 32768 for v in embedding]"
_LONG = """with v as (select 'L' || label || '/B' || vec_id // 100 || '.wav' as name, vec_id, {levels} as x from embeddings),
f as (select name, flatten(list(x order by vec_id)) as x from v group by name)"""


@query(f"""with v as (select vec_id, label::varchar as label, 'L' || label || '/B' || vec_id // 100 || '.wav' as name, (row_number() over (partition by label, vec_id // 100 order by vec_id) - 1) * 64 as start,
{_LEVELS} as x from embeddings)
select name, start, label, list_max([abs(v) for v in x]) as peak, round(list_sum([v * v for v in x]), 6) as energy, list_max([abs(v) for v in x]) > 0.3 as loud from v where label <> '3' or list_max([abs(v) for v in x]) > 0.3""")
def dataset_life(spark, d):
    """A dataset built on some files, appended to with the others, given a feature, compacted, and asked by index: what the build made of the old rows the updates make of the new ones."""
    root, out = written(spark, d), work_dir(spark, "dataset")
    peak = registry.sql_feature("peak", "cast(array_max(transform(element_at(waveform, 1), v -> abs(v))) as double)", hash_expression="if(peak > 0.3D, 'loud', 'soft')")
    dataset.preprocess(spark, [root], out, Windows(64, hop=64), features=[peak], patterns=["L{{label}}/*.wav"], include=[f"L{k}/*" for k in range(0, 10, 2)])
    dataset.update(spark, out, [root], include=["*"])
    dataset.update(spark, out, features={"energy": "round(aggregate(element_at(waveform, 1), 0D, (a, v) -> a + cast(v as double) * v), 6)"})
    made = dataset.compact(spark, out)
    others = [str(k) for k in range(10) if k != 3]
    labels = {r.value for r in made.index.where((F.col("feature") == "label") & F.col("value").isin(others)).select("value").distinct().collect()}  # ten at most
    rows = made.query(label=sorted(labels)).unionByName(made.query(label="3", peak="loud"))
    name = F.regexp_extract("file_path", r"(L\d+/B\d+\.wav)$", 1)
    return rows.select(name.alias("name"), F.round(F.col("start_pos") * 8000).cast("long").alias("start"), "label", "peak", "energy", (F.col("peak") > 0.3).alias("loud"))


@query(
    _LONG.format(levels=_LEVELS)
    + """, w as (select name, s as start, x[s + 1 : s + 96] as w from (select name, x, unnest(range(0, len(x) - 40 + 1, 80)) as s from f where len(x) >= 40) where s >= 80 and s < 4000)
select name, start, len(w) as n, w[1] as first, round(list_sum(w), 6) as total from w"""
)
def ranged_windows(spark, d):
    """Windows of files, by byte ranges of 2 kB, from the second on; the comparisons of start are pushed down."""
    cut = signals.source(spark, written(spark, d), Windows(96, hop=80, pad="zero", least=40), split_bytes=2048)
    x = F.element_at("waveform", 1)
    name = F.regexp_extract("file_path", r"(L\d+/B\d+\.wav)$", 1)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return cut.where("start >= 80 and start < 4000").select(name.alias("name"), "start", F.size(x).cast("long").alias("n"), F.element_at(x, 1).cast("double").alias("first"), F.round(total, 6).alias("total"))
