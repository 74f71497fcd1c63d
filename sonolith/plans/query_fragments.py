"""Scans, fragments, padding, codecs, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, globs, spectra
from ..operators import fragment, pattern
from .registry import query


def signals(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("waveform"))


_WINDOWS = """with w as (select vec_id, label, s as start, embedding[s + 1 : s + {chunk}] as w
from (select *, unnest(range(0, len(embedding) - {least} + 1, {hop})) as s from embeddings))"""


@query(
    _WINDOWS.format(chunk=32, hop=16, least=32)
    + """, l as (select label, 10 * log10(list_sum([cast(v as double) * cast(v as double) for v in w]) / 32) as db from w)
select label, count(*) as n_fragments, round(avg(db), 4) as mean_db from l where db >= -21 group by label"""
)
def flagship_fragments(spark, d):
    """Windows of 32 by 16, those of at least -21 dB, their number and mean level by label."""
    cut = fragment.fragments(signals(spark, d), fragment.Windows(32, hop=16))
    level = cut.select("label", arrays.rms_db(F.col("waveform")).alias("db")).where("db >= -21")
    return level.groupBy("label").agg(F.count("*").alias("n_fragments"), F.round(F.avg("db"), 4).alias("mean_db"))


def _shown(rows, last):
    w = F.col("waveform")
    picked = [F.element_at(w, k).cast("double").alias(f"w{k}") for k in (1, 33, 34, last)]
    return rows.select("vec_id", F.col("start").cast("long").alias("start"), F.size(w).cast("long").alias("n"), *picked)


_SHOWN = "select vec_id, start, len(p) as n, cast(p[1] as double) as w1, cast(p[33] as double) as w33, cast(p[34] as double) as w34, cast(p[48] as double) as w48 from p"


def _padded(expr):
    return _WINDOWS.format(chunk=48, hop=32, least=1) + f", p as (select vec_id, start, case when len(w) >= 48 then w else {expr} end as p from w) " + _SHOWN


@query(_WINDOWS.format(chunk=48, hop=16, least=48) + ", p as (select vec_id, start, w as p from w) " + _SHOWN)
def chunk_discard(spark, d):
    return _shown(fragment.fragments(signals(spark, d), fragment.Windows(48, hop=16)), 48)


@query(_padded("list_concat(w, [cast(0 as float) for i in range(48 - len(w))])"))
def chunk_zero(spark, d):
    return _shown(fragment.fragments(signals(spark, d), fragment.Windows(48, hop=32, pad="zero")), 48)


@query(_padded("list_concat(w, [w[len(w)] for i in range(48 - len(w))])"))
def chunk_replicate(spark, d):
    return _shown(fragment.fragments(signals(spark, d), fragment.Windows(48, hop=32, pad="replicate")), 48)


@query(_padded("list_concat(w, w[1 : 48 - len(w)])"))
def chunk_repeat(spark, d):
    return _shown(fragment.fragments(signals(spark, d), fragment.Windows(48, hop=32, pad="repeat")), 48)


@query(_padded("list_concat(w, list_reverse(w[len(w) - (48 - len(w)) : len(w) - 1]))"))
def chunk_reflect(spark, d):
    return _shown(fragment.fragments(signals(spark, d), fragment.Windows(48, hop=32, pad="reflect")), 48)


@query(_WINDOWS.format(chunk=40, hop=8, least=40) + " select vec_id, count(*) as n_fragments, max(start) as last_start from w group by vec_id")
def chunk_overlap(spark, d):
    cut = fragment.fragments(signals(spark, d), fragment.Windows(40, overlap=0.8))
    return cut.groupBy("vec_id").agg(F.count("*").alias("n_fragments"), F.max("start").cast("long").alias("last_start"))


@query(_WINDOWS.format(chunk=40, hop=24, least=20) + " select vec_id, count(*) as n_fragments, max(start) as last_start from w group by vec_id")
def chunk_min_size(spark, d):
    cut = fragment.fragments(signals(spark, d), fragment.Windows(40, hop=24, pad="zero", least=0.5))
    return cut.groupBy("vec_id").agg(F.count("*").alias("n_fragments"), F.max("start").cast("long").alias("last_start"))


@query("select vec_id, 3::bigint as channels, cast(embedding[1] as double) as c0, cast(embedding[33] as double) as c1, cast(embedding[1] as double) as c2 from embeddings")
def channel_fix(spark, d):
    """The signal as two channels of 32, then as three: the third is the first again."""
    x = F.array(F.slice("waveform", 1, 32), F.slice("waveform", 33, 32))
    fixed = signals(spark, d).select("vec_id", arrays.fix_channels(x, 3).alias("c"))
    first = lambda k: F.col("c")[k][0].cast("double")
    return fixed.select("vec_id", F.size("c").cast("long").alias("channels"), first(0).alias("c0"), first(1).alias("c1"), first(2).alias("c2"))


_Q = "[cast(trunc(greatest(least(cast(v as double), 1.0::double), -1.0::double) * 32767.0::double) as bigint) for v in embedding]"


@query(f"select vec_id, list_sum({_Q})::bigint as total, list_min({_Q})::bigint as lowest, list_max({_Q})::bigint as highest from embeddings")
def quantize_int16(spark, d):
    q = signals(spark, d).select("vec_id", arrays.quantise(F.col("waveform")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v)
    return q.select("vec_id", total.alias("total"), F.array_min("q").cast("long").alias("lowest"), F.array_max("q").cast("long").alias("highest"))


@query(f"select vec_id, round(list_max([abs(q / 32767.0::double - cast(v as double)) for q, v in list_zip({_Q}, embedding)]), 9) as error from embeddings".replace("[abs(q / 32767.0::double - cast(v as double)) for q, v in list_zip(" + _Q + ", embedding)]", "list_transform(list_zip(" + _Q + ", embedding), lambda z: abs(z[1] / 32767.0::double - cast(z[2] as double)))"))
def roundtrip_error(spark, d):
    x = F.col("waveform")
    back = arrays.dequantise(arrays.quantise(x))
    return signals(spark, d).select("vec_id", F.round(F.array_max(F.zip_with(back, x, lambda a, b: F.abs(a - b.cast("double")))), 9).alias("error"))


@query(_WINDOWS.format(chunk=32, hop=32, least=32) + " select vec_id, start, round(10 * log10(list_sum([cast(v as double) * cast(v as double) for v in w]) / 32), 5) as db from w where 10 * log10(list_sum([cast(v as double) * cast(v as double) for v in w]) / 32) >= -20.5")
def rms_filter(spark, d):
    cut = fragment.louder(fragment.fragments(signals(spark, d), fragment.Windows(32)), -20.5, arrays.rms_db)
    return cut.select("vec_id", F.col("start").cast("long").alias("start"), F.round(arrays.rms_db(F.col("waveform")), 5).alias("db"))


@query("select page_id, url from pages where url glob '*example.com/en/*' or url glob 'https://m.*'")
def scan_glob_include(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where(globs.any_of(F.col("url"), ["*example.com/en/*", "https://m.*"])).select("page_id", "url")


@query("select page_id, url from pages where not url glob '*.html' and not url glob '*[?]page=*'")
def scan_glob_exclude(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where(globs.none_of(F.col("url"), ["*.html", "*[?]page=*"])).select("page_id", "url")


@query("select vec_id, cast(embedding[1] as double) as _0, len(embedding[1:8]) as _1 from embeddings")
def pattern_tuple(spark, d):
    got = pattern.project(signals(spark, d), "(waveform[0], waveform[:8])", keep=("vec_id",))
    return got.select("vec_id", F.col("_0").cast("double").alias("_0"), F.size("_1").cast("long").alias("_1"))


@query("select vec_id, cast(embedding[3] as double) as z, label::bigint as label from embeddings")
def pattern_dict(spark, d):
    got = pattern.project(signals(spark, d), "{ waveform[2] -> z, label, }", keep=("vec_id",))
    return got.select("vec_id", F.col("z").cast("double").alias("z"), F.col("label").cast("long").alias("label"))


@query("select vec_id, len(embedding[5:20:3]) as n, cast(embedding[5] as double) as first, cast(embedding[20] as double) as last from embeddings")
def pattern_slice(spark, d):
    got = pattern.project(signals(spark, d), "{waveform:array[4:20:3]->w}", keep=("vec_id",))
    return got.select("vec_id", F.size("w").cast("long").alias("n"), F.element_at("w", 1).cast("double").alias("first"), F.element_at("w", -1).cast("double").alias("last"))


@query("""with x as (select vec_id, list_concat([0::float, 0::float, 0::float], embedding) as x from embeddings), f as (select vec_id, k as frame, x[k * 14 + 1 : k * 14 + 20] as w from (select vec_id, x, unnest(range(0, ceil((len(x) - 20) / 14)::bigint + 1)) as k from x))
select vec_id, frame::int as frame, round(list_sum([v::double for v in w]), 6) as total, case when len(w) >= 20 then w[20]::double else 0.0 end as last from f""")
def frames_padded(spark, d):
    """Overlapped frames, the last one filled up with zeros."""
    x = F.col("waveform")
    rows = fragment.framed(signals(spark, d), 20, 14, lead=3)
    return rows.select("vec_id", "frame", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"), F.element_at(x, 20).cast("double").alias("last"))


@query("select vec_id, generate_subscripts(embedding, 1)::bigint - 1 as place, unnest(embedding)::double as value from embeddings")
def frames_unwrapped(spark, d):
    """Frames with half of their overlap cut off at either end are the signal again."""
    frames = fragment.framed(signals(spark, d).withColumn("n", F.size("waveform")), 20, 14, lead=3)
    flat = fragment.unwrapped(frames, 6, F.col("n"), values="waveform")
    return flat.select("vec_id", "start", F.posexplode("waveform").alias("k", "value")).select("vec_id", (F.col("start") + F.col("k")).alias("place"), F.col("value").cast("double").alias("value"))


def _matrix():
    """An embedding as four frames of sixteen bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, F.lit(16)))


@query("""with p as (select vec_id, [10 * log10(v::double * v::double + 1e-10) for v in embedding] as d from embeddings), r as (select vec_id, d, list_min(d) as low, list_max(d) - list_min(d) as span from p)
select vec_id, round(list_sum([(v - low) / span for v in d]), 5) as total, round((d[17] - low) / span, 5) as second_frame, 1.0::double as top from r""")
def db_scaling(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", spectra.db_scaled(_matrix()).alias("m"))
    total = F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v)
    return e.select("vec_id", F.round(total, 5).alias("total"), F.round(F.element_at("m", 2)[0], 5).alias("second_frame"), F.array_max(F.flatten("m")).alias("top"))


@query("""with h as (select vec_id, embedding, h as harmonic, [-12, 0, 12, 19][h + 1] as s from embeddings, range(0, 4) t(h)), f as (select *, f as frame from h, range(0, 4) t(f))
select vec_id, harmonic::int as harmonic, frame::int as frame, round(coalesce(list_sum([embedding[frame * 16 + k + s + 1]::double * (k + 1) for k in range(0, 14) if k + s >= 0 and k + s < 16]), 0), 5) as weighed from f""")
def harmonic_stack(spark, d):
    """Bins beside those of their harmonics, an octave below to the third above, weighed by their place."""
    stack = spectra.harmonic_stack(_matrix(), [0.5, 1, 2, 3], 1, 14)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(stack).alias("harmonic", "m")).select("vec_id", "harmonic", F.posexplode("m").alias("frame", "x"))
    weighed = F.aggregate(F.transform("x", lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", "harmonic", "frame", F.round(weighed, 5).alias("weighed"))
