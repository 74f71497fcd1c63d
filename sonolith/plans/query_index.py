"""The index, lookups, features from paths, metadata, reports, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, meta
from ..operators import incremental, index
from .registry import query


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").drop("text")


def labelled(spark, d):
    return docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")


def doc_index(spark, d):
    return index.feature_index(docs(spark, d), {"lang": F.col("lang"), "source": F.col("source")}, "doc_id")


@query("select source, count(*) as n_chunks from documents group by source")
def file_index_counts(spark, d):
    return index.files(docs(spark, d), "source")


@query("""select 'lang' as feature, lang as value, count(*) as n_keys, min(doc_id) as first_key, max(doc_id) as last_key from documents where lang is not null group by lang
union all select 'source', source, count(*), min(doc_id), max(doc_id) from documents where source is not null group by source""")
def feature_index(spark, d):
    return index.value_counts(doc_index(spark, d))


@query("""select f as feature, present, total - present as missing from (select count(*) as total, count(quality) as q, count(toxic) as t, count(lang) as l
from documents left join labels using (doc_id)), unnest([{'f': 'quality', 'present': q}, {'f': 'toxic', 'present': t}, {'f': 'lang', 'present': l}]) as u(s), lateral (select s.f as f, s.present as present)""")
def feature_status(spark, d):
    return index.status(labelled(spark, d), ["quality", "toxic", "lang"])


@query("select doc_id, quality::bigint as quality from documents join labels using (doc_id) where quality is not null and toxic is not null")
def required_fields(spark, d):
    return index.required(labelled(spark, d), ["quality", "toxic"]).select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("select bucket, count(*) as present from (select doc_id // 32768 + 1 as bucket from documents join labels using (doc_id) where toxic is not null and doc_id >= 1) group by bucket")
def feature_bitmap(spark, d):
    """Presence of a feature as bitmaps over positions from 1 on."""
    rows = labelled(spark, d).where("doc_id >= 1").withColumn("position", F.col("doc_id") + 1)
    return index.bitmap(rows, "toxic", "position").select("bucket", "present")


@query("select doc_id from documents where lang in ('de', 'fr') and source in ('src1', 'src2', 'src3')")
def query_and(spark, d):
    return index.lookup(doc_index(spark, d), {"lang": ["de", "fr"], "source": ["src1", "src2", "src3"]}).select(F.col("key").alias("doc_id"))


@query("select doc_id from documents where lang in ('es', 'fr')")
def query_or(spark, d):
    return index.lookup(doc_index(spark, d), {"lang": ["es", "fr"]}).select(F.col("key").alias("doc_id"))


@query("select source, doc_id, rn from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 3")
def query_first_n(spark, d):
    return index.first_n(docs(spark, d).select("source", "doc_id"), "source", "doc_id", 3).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("""with p as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as place from documents),
n as (select lang, count(*) as n from documents group by lang),
k as (select lang, draw, cast('0x' || md5('7:' || lang || '/' || draw)[1:8] as bigint) % n as place from n, range(1, 6) as r(draw))
select lang, draw, doc_id from k join p using (lang, place)""")
def query_sample_n(spark, d):
    """Five draws with replacement from each language."""
    return index.sample_n(docs(spark, d).select("lang", "doc_id"), "lang", "doc_id", 5, 7).select("lang", F.col("draw").cast("long").alias("draw"), "doc_id")


@query("select source, count(*) as n_chunks, count(quality) as n_labelled from documents left join labels using (doc_id) group by source")
def info_files(spark, d):
    return labelled(spark, d).groupBy("source").agg(F.count("*").alias("n_chunks"), F.count("quality").alias("n_labelled"))


@query("""select doc_id, 'quality' as feature from documents left join labels using (doc_id) where quality is null
union all select doc_id, 'toxic' from documents left join labels using (doc_id) where toxic is null""")
def info_missing(spark, d):
    return index.missing(labelled(spark, d), ["quality", "toxic"], "doc_id")


@query(r"select page_id, nullif(regexp_extract(url, '^(?:.*/)?(\w+)/[0-9]+', 1), '') as lang from pages")
def regexp_feature(spark, d):
    path = F.regexp_replace("url", r"(/[0-9]+).*$", "$1.page")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", globs.captured(path, ["{{lang}}/*.page"], "lang").alias("lang"))


@query(r"""select page_id, coalesce(nullif(regexp_extract(url, '^(?:.*/)?(?:.*/)(\w+)/[^/]*\.html$', 1), ''), nullif(regexp_extract(url, '^(?:.*/)?(\w+)/[^/]*$', 1), '')) as section from pages""")
def regexp_multi(spark, d):
    """Two patterns for one field: the first that gives something counts."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", globs.captured(F.col("url"), ["**/{{section}}/*.html", "{{section}}/*"], "section").alias("section"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as n_keys from events")
def meta_json_get(spark, d):
    """A field of the JSON metadata, by the first of its keys."""
    parsed = F.from_json("props", "map<string,string>")
    keys = F.json_object_keys("props")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.element_at(parsed, F.element_at(keys, 1)).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


_KEYED = """with n as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as k from documents {where}),
s as (select source, count(*) as c from n group by source),
b as (select source, sum(c) over (order by md5(source)[1:2], source rows between unbounded preceding and 1 preceding) as low from s)
select source, doc_id, lpad(cast(coalesce(low, 0) + k + {first} as varchar), 9, '0') as frag_key from n join b using (source)"""


@query(_KEYED.format(where="", first=0))
def frag_keys(spark, d):
    rows = docs(spark, d).select("source", "doc_id")
    return incremental.numbered(rows, 0, ["doc_id"], "source").select("source", "doc_id", "frag_key")


@query(_KEYED.format(where="where source not in ('src0', 'src1', 'src2', 'src3')", first=1000))
def incremental_append(spark, d):
    """Four sources are stored, with keys up to 999; the others' rows are appended."""
    rows = docs(spark, d).select("source", "doc_id")
    known = rows.where("source in ('src0', 'src1', 'src2', 'src3')").withColumn("frag_key", F.lit("000000999"))
    return incremental.append(known, rows, "source", ["doc_id"]).select("source", "doc_id", "frag_key")


@query("select doc_id, coalesce(quality, -1)::bigint as quality, n_chars // 100 as size from documents left join labels using (doc_id)")
def feature_backfill(spark, d):
    filled = incremental.backfill(labelled(spark, d), {"quality": F.lit(-1), "size": F.floor(F.col("n_chars") / 100)})
    return filled.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("size").cast("long").alias("size"))


@query("""select event_id, coalesce(json_extract_string(props, '$.kind'), 'none') as kind, 'x' || event_id::varchar as tag, len(list_filter(json_keys(props), lambda k: k <> json_keys(props)[1] and k not in ('kind', 'tag'))) + 2 as n from events""")
def meta_update(spark, d):
    """Two fields are set, the first of the old ones goes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    old = meta.parsed(F.col("props"))
    first = F.element_at(F.json_object_keys("props"), 1)
    kept = F.map_filter(old, lambda k, _: k != first)
    new = meta.put(kept, kind=F.coalesce(meta.get(old, "kind"), F.lit("none")), tag=F.concat(F.lit("x"), F.col("event_id")))
    back = meta.parsed(meta.written(new))
    return e.select("event_id", meta.get(back, "kind").alias("kind"), meta.get(back, "tag").alias("tag"), F.size(back).cast("long").alias("n"))


@query("""select doc_id, [case when ascii('A') > 0 then chr(cast(97 + cast('0x' || md5('3:' || doc_id)[4 * k + 1:4 * k + 4] as bigint) % 25 as int)) end for k in range(0, 8)].list_aggregate('string_agg', '') as tag from documents""")
def random_tag(spark, d):
    return docs(spark, d).select("doc_id", meta.tag(F.col("doc_id"), 3).alias("tag"))
