"""Augmentations and signal features on the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions import transforms as t
from ..functions.keys import uniform
from ..operators import cluster, notes, signal
from .query_fragments import signals
from .registry import query

SR = 64


def _some(spark, d, y):
    """Four samples, the largest and the place-weighted sum of a changed signal."""
    rows = signals(spark, d).select("vec_id", y.alias("y"))
    at = [F.round(F.element_at("y", k).cast("double"), 6).alias(f"y{k}") for k in (1, 2, 17)]
    weighted = F.aggregate(F.zip_with("y", F.sequence(F.lit(1), F.size("y")), lambda v, i: v.cast("double") * i), F.lit(0.0), lambda s, v: s + v)
    return rows.select("vec_id", F.size("y").cast("long").alias("n"), *at, F.round(weighted, 4).alias("weighted"))


def _sql(y, extra=""):
    return f"""with x as (select vec_id, [cast(v as double) for v in embedding] as x {extra} from embeddings), y as (select vec_id, {y} as y from x)
select vec_id, len(y) as n, round(cast(y[1] as double), 6) as y1, round(cast(y[2] as double), 6) as y2, round(cast(y[17] as double), 6) as y17,
round(list_sum([y[i] * i for i in range(1, len(y) + 1)]), 4) as weighted from y"""


def _u(seed):
    return f", cast(cast('0x' || md5('{seed}:' || vec_id)[1:13] as bigint) as double) / 4503599627370496.0::double as u"


def _impulse(b, a, n=64):
    """A recursive filter's answer to an impulse, sample by sample: what the SQL convolves with."""
    y = []
    for i in range(n):
        y.append((b[i] if i < len(b) else 0.0) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
    return y


def _literal(values):
    return "[" + ", ".join(f"{v!r}::double" for v in map(float, values)) + "]"


def _convolved(h, x="x"):
    return f"[list_sum([({_literal(h)})[k] * {x}[i - k + 1] for k in range(1, i + 1)]) for i in range(1, 65)]"


def _biquad(kind, freq, q, gain=0.0):
    b, a = dsp.biquad(kind, SR, freq, q, gain)
    return [v / a[0] for v in b], [v / a[0] for v in a]


def _chain(*filters):
    """The impulse response of filters one after the other."""
    h = [1.0] + [0.0] * 63
    for b, a in filters:
        own = _impulse(b, a)
        h = [sum(own[k] * h[i - k] for k in range(i + 1)) for i in range(64)]
    return h


def _resampled(up, down):
    """Direct sums with the Kaiser-windowed kernel."""
    half = 10 * max(up, down)
    kernel = [float(np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)[t + half]) for t in range(-half, half + 1)]
    kernel = [v * up / sum(kernel) for v in kernel]
    taps = f"(case when m * {down} - (k - 1) * {up} between {-half} and {half} then ({_literal(kernel)})[m * {down} - (k - 1) * {up} + {half + 1}] * x[k] else 0 end)"
    return f"[list_sum([{taps} for k in range(1, 65)]) for m in range(0, {-(-64 * up // down)})]"


_PEAK = "list_max([abs(v) for v in x])"


@query(_sql("[v * pow(10.0::double, (u * 15 - 12) / 20) / greatest(list_max([abs(q) for q in x]) * pow(10.0::double, (u * 15 - 12) / 20), 1.0) for v in x]", _u(1)))
def xform_gain(spark, d):
    return _some(spark, d, t.gain(F.col("waveform"), uniform(F.col("vec_id"), 1) * 15 - 12))


@query(_sql("[v * least(1.0::double / list_max([abs(q) for q in x]), 31.622776601683793::double) for v in x]"))
def xform_normalize(spark, d):
    return _some(spark, d, t.normalise(F.col("waveform")))


@query(_sql("[x[i] - 0.97::double * (case when i > 1 then x[i - 1] else 0 end) for i in range(1, len(x) + 1)]"))
def xform_preemphasis(spark, d):
    return _some(spark, d, t.pre_emphasis(F.col("waveform")))


@query(_sql("[(x[i] - (case when i > 1 then x[i - 1] else 0 end)) / 2 for i in range(1, len(x) + 1)]"))
def xform_derivative(spark, d):
    return _some(spark, d, t.derivative(F.col("waveform")))


@query(_sql("list_reverse(x)"))
def xform_reverse(spark, d):
    return _some(spark, d, t.reverse(F.col("waveform")))


@query(_sql("x[cast(floor(u * 25) as bigint) + 1 : cast(floor(u * 25) as bigint) + 40]", _u(2)))
def xform_crop(spark, d):
    return _some(spark, d, t.crop(F.col("waveform"), 40, uniform(F.col("vec_id"), 2)))


@query(_sql("[greatest(least(v, 0.1::double), -0.1::double) for v in x]"))
def xform_clip(spark, d):
    return _some(spark, d, t.clip(F.col("waveform"), -0.1, 0.1))


@query(_sql("[greatest(least(v, list_sort(x)[len(x) - 3]), list_sort(x)[4]) for v in x]"))
def xform_clip_share(spark, d):
    return _some(spark, d, t.clip_share(F.col("waveform"), 0.1))


@query(_sql("[tanh(v * 4) for v in x]"))
def xform_tanh(spark, d):
    return _some(spark, d, t.tanh(F.col("waveform")))


@query(_sql("[-v for v in x]"))
def xform_polarity(spark, d):
    return _some(spark, d, t.polarity(F.col("waveform")))


@query(_sql("case when u < 0.1::double then [0.0::double for v in x] else x end", _u(3)))
def xform_mute(spark, d):
    return _some(spark, d, t.maybe(F.transform(F.col("waveform"), lambda v: v.cast("double")), t.mute(F.col("waveform")), F.col("vec_id"), 0.1, 3))


@query(_sql("[case when i - 1 >= vec_id % 40 and i - 1 < vec_id % 40 + 9 then 0 else x[i] end for i in range(1, len(x) + 1)]"))
def xform_timemask(spark, d):
    return _some(spark, d, t.time_mask(F.col("waveform"), (F.col("vec_id") % 40).cast("int"), 9))


@query(_sql("list_concat(x[65 - (vec_id % 64) : 64], x[1 : 64 - (vec_id % 64)])"))
def xform_shift(spark, d):
    return _some(spark, d, t.shift(F.col("waveform"), (F.col("vec_id") % 64).cast("int")))


#: Delay 3.25: through the delays 4 and 5 at -0.75, on 59 samples; two mirrored ones in front and three behind.
_WET = "[x[n + 5] + 0.5::double * (1.75::double * x[n + 1] - 0.75::double * x[n]) for n in range(1, 60)]"


@query(_sql("list_concat([w[3], w[2]], w, [w[58], w[57], w[56]])", f", {_WET.replace('x[', 'embedding[')} as w"))
def xform_delay(spark, d):
    return _some(spark, d, t.delay(F.col("waveform"), F.lit(3.25), F.lit(0.5)))


@query(_sql("[(round(v * 16) + 0.0::double) / 16 for v in x]"))
def xform_bitcrush(spark, d):
    return _some(spark, d, t.bitcrush(F.col("waveform")))


@query(_sql("[x[i - (i - 1) % 3] for i in range(1, len(x) + 1)]"))
def xform_aliasing(spark, d):
    return _some(spark, d, t.aliasing(F.col("waveform"), 3))


@query(_sql("[x[i] * pow(10.0::double, (-6 + 12 * (i - 1) / 63.0::double) / 20) for i in range(1, len(x) + 1)]"))
def xform_gain_transition(spark, d):
    return _some(spark, d, t.gain_transition(F.col("waveform"), F.lit(-6.0), F.lit(6.0)))


@query(_sql("list_concat(x[1:10], x[11:18], x[11:18], x[11:18], x[19:64])[1:64]"))
def xform_repeat_part(spark, d):
    return _some(spark, d, t.repeat_part(F.col("waveform"), F.lit(10), 8, 2))


@query(_sql("list_concat(x, [0.0::double for i in range(16)])"))
def xform_adjust_duration(spark, d):
    return _some(spark, d, t.adjust_duration(F.col("waveform"), 80))


@query("select vec_id, list_position([case when i = label then 1 else 0 end for i in range(10)], 1)::bigint - 1 as hot, 10::bigint as n from embeddings")
def one_hot(spark, d):
    rows = signals(spark, d).select("vec_id", t.one_hot(F.col("label"), 10).alias("h"))
    return rows.select("vec_id", (F.array_position("h", 1) - 1).alias("hot"), F.size("h").cast("long").alias("n"))


def _uniform_sql(seed):
    return f"cast(cast('0x' || md5('{seed}:' || vec_id || '/' || i)[1:13] as bigint) as double) / 4503599627370496.0::double"


@query(f"""with e as (select vec_id, 0.01::double * sqrt(-2 * ln(greatest({_uniform_sql("11a")}, 1e-16))) * cos(({_uniform_sql("11b")}) * 6.283185307179586::double) as e from embeddings, range(0, 64) as r(i))
select vec_id, round(avg(e), 6) as mean, round(stddev(e), 6) as std from e group by vec_id""")
def xform_noise(spark, d):
    """Noise of a given deviation: what it adds, by its mean and deviation."""
    added = F.zip_with(t.add_noise(F.col("waveform"), F.col("vec_id"), 11, 0.01), F.col("waveform"), lambda a, b: a - b.cast("double"))
    return signals(spark, d).select("vec_id", F.explode(added).alias("e")).groupBy("vec_id").agg(F.round(F.avg("e"), 6).alias("mean"), F.round(F.stddev("e"), 6).alias("std"))


_ALPHA = 1 / (1 + 20 * np.pi / SR)


@query(_sql(_convolved(_impulse((_ALPHA**2, -(_ALPHA**2)), (1, -2 * _ALPHA, _ALPHA**2)))))
def xform_integrator(spark, d):
    return _some(spark, d, signal.integrator(SR)(F.col("waveform")))


@query(_sql(_convolved(_impulse(*_biquad("lowpass", 8, 0.7071067811865476)))))
def xform_biquad(spark, d):
    return _some(spark, d, signal.filtered("lowpass", SR, 8)(F.col("waveform")))


@query(_sql(_convolved(_chain(_biquad("lowshelf", 4, 0.7, 3), _biquad("peak", 10, 1, -6), _biquad("highshelf", 20, 0.7, 2)))))
def xform_equaliser(spark, d):
    return _some(spark, d, signal.equaliser(SR, [("lowshelf", 4, 0.7, 3), ("peak", 10, 1, -6), ("highshelf", 20, 0.7, 2)])(F.col("waveform")))


#: A periodic Hann window of 16, and what bins 4 to 6 hold of a sample that lies so many places off.
_HANN = _literal([0.5 - 0.5 * np.cos(2 * np.pi * k / 16) for k in range(16)])
_BINS = _literal([sum(np.cos(2 * np.pi * b * k / 16) for b in (4, 5, 6)) / 8 for k in range(16)])
_MASKED = f"""with x as (select vec_id, [embedding[(case when i < 0 then -i when i > 63 then 126 - i else i end) + 1]::double for i in range(-8, 72)] as p, {_HANN} as w, {_BINS} as b from embeddings),
s as (select *, [[p[4 * k + n] * w[n] for n in range(1, 17)] for k in range(0, 17)] as s from x),
m as (select vec_id, w, [[f[n] - list_sum([f[m] * b[(n - m + 16) % 16 + 1] for m in range(1, 17)]) for n in range(1, 17)] for f in s] as m from s),
y as (select vec_id, [list_sum([m[k + 1][i - 4 * k + 1] * w[i - 4 * k + 1] for k in range(0, 17) if i - 4 * k >= 0 and i - 4 * k < 16]) / list_sum([pow(w[i - 4 * k + 1], 2) for k in range(0, 17) if i - 4 * k >= 0 and i - 4 * k < 16]) for i in range(8, 72)] as y from m)
select vec_id, len(y) as n, round(y[1], 6) as y1, round(y[2], 6) as y2, round(y[17], 6) as y17, round(list_sum([y[i] * i for i in range(1, 65)]), 4) as weighted from y"""


@query(_MASKED)
def xform_freqmask(spark, d):
    return _some(spark, d, signal.mask_frequencies(4, 3, 16)(F.col("waveform")))


@query(_sql(_resampled(3, 2)))
def xform_resample(spark, d):
    return _some(spark, d, signal.resample(3, 2)(F.col("waveform")))


@query(_sql("[v * list_max([abs(q) for q in x]) / list_max([abs(q) for q in z]) for v in z]", f", (select {_resampled(6, 5)} from (select [cast(v as double) for v in embedding] as x)) as z"))
def xform_stretch(spark, d):
    return _some(spark, d, signal.stretch(6, 5)(F.col("waveform")))


_UP = 1 - float(np.exp(-1 / (0.1 * SR)))
#: The level that follows the signal; its line between -80, -40 (which becomes -20) and 0 dB, with parabolas within 3 dB of the bends.
_BENT = """case when d < -83 then d when d <= -77 then d + 0.5 * (d + 83) * (d + 83) / 12 when d < -43 then -80 + 1.5 * (d + 80)
when d <= -37 then -24.5 + 1.5 * (d + 43) - (d + 43) * (d + 43) / 12 when d < -3 then 0.5 * d when d <= 3 then -1.5 + 0.5 * (d + 3) + 0.5 * (d + 3) * (d + 3) / 12 else d end"""
_COMPRESSED = f"""with x as (select vec_id, [cast(v as double) for v in embedding] as x from embeddings),
f as (select vec_id, x, [20 * log10(greatest(list_sum([{_UP!r}::double * pow({1 - _UP!r}::double, i - k) * abs(x[k]) for k in range(1, i + 1)]) + pow({1 - _UP!r}::double, i), 1e-10)) for i in range(1, 65)] as db from x),
g as (select vec_id, [x[i] * pow(10, (list_transform([db[i]], lambda d: {_BENT})[1] - db[i]) / 20) for i in range(1, 65)] as y0 from f),
y as (select vec_id, [v / greatest(1.0, list_max([abs(w) for w in y0])) for v in y0] as y from g)
select vec_id, len(y) as n, round(y[1], 6) as y1, round(y[2], 6) as y2, round(y[17], 6) as y17, round(list_sum([y[i] * i for i in range(1, 65)]), 4) as weighted from y"""


@query(_COMPRESSED)
def xform_compress(spark, d):
    return _some(spark, d, signal.compress(SR)(F.col("waveform")))


@query(_sql("[x[i] + 0.5::double * (case when i > 1 then x[i - 1] else 0 end) + 0.25::double * (case when i > 2 then x[i - 2] else 0 end) for i in range(1, 65)]"))
def xform_impulse_response(spark, d):
    return _some(spark, d, signal.convolve([1.0, 0.5, 0.25])(F.col("waveform")))


@query()
def xform_coloured_noise(spark, d):
    return _some(spark, d, signal.add_coloured_noise(1.0, 0.01)(F.col("waveform")))


_CLAMPED = "[greatest(-1.0, least(1.0, v)) for v in {}]"
#: Shelf and high-pass at ten times the rate; a signal this short is one block.
_SHELF, _HIGH = ([[v / a[0] for v in b], [v / a[0] for v in a]] for b, a in (dsp.biquad("highshelf", SR * 10, 1500, 0.5**0.5, 4.0), dsp.biquad("highpass", SR * 10, 38, 0.5)))
_LOUD = f"""with x as (select vec_id, [cast(v as double) for v in embedding] as x from embeddings), s as (select vec_id, x, {_CLAMPED.format(_convolved(_impulse(*_SHELF)))} as s from x),
h as (select vec_id, x, {_CLAMPED.format(_convolved(_impulse(*_HIGH), "s"))} as h from s), l as (select vec_id, x, -0.691 + 10 * log10(list_sum([v * v for v in h]) / 64) as lufs from h)"""


@query(_LOUD + " select vec_id, round(lufs, 4) as lufs from l")
def loudness_gated(spark, d):
    return signals(spark, d).select("vec_id", F.round(signal.loudness(SR * 10)(F.col("waveform")), 4).alias("lufs"))


@query(_LOUD + """, y as (select vec_id, [v * pow(10, (-23.0 - lufs) / 20) for v in x] as y from l)
select vec_id, len(y) as n, round(y[1], 6) as y1, round(y[2], 6) as y2, round(y[17], 6) as y17, round(list_sum([y[i] * i for i in range(1, 65)]), 4) as weighted from y""")
def loudness_match(spark, d):
    return _some(spark, d, signal.match_loudness(SR * 10, -23.0)(F.col("waveform")))


def _shape(spark, d, m):
    rows = signals(spark, d).select("vec_id", m.alias("m"))
    return rows.select("vec_id", F.size("m").cast("long").alias("bins"), F.size(F.col("m")[0]).cast("long").alias("frames"), F.round(F.col("m")[1][0], 5).alias("value"))


def _mel_row(row, n_mels, n_fft):
    """The weights of a mel band's triangle on the bins of a transform."""
    edges = [700 * (10 ** (k / (n_mels + 1) * np.log10(1 + SR / 2 / 700)) - 1) for k in range(n_mels + 2)]
    low, mid, high = edges[row : row + 3]
    return [max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in (k * SR / n_fft for k in range(n_fft // 2 + 1))]


@query(f"""with x as (select vec_id, [embedding[abs(k) + 1]::double * (0.5 - 0.5 * cos(2 * pi() * (k + 8) / 16)) for k in range(-8, 8)] as x from embeddings),
p as (select vec_id, [pow(list_sum([x[k + 1] * cos(2 * pi() * b * k / 16) for k in range(0, 16)]), 2) + pow(list_sum([x[k + 1] * sin(2 * pi() * b * k / 16) for k in range(0, 16)]), 2) for b in range(0, 9)] as p from x)
select vec_id, 5::bigint as bins, 9::bigint as frames, round(list_sum([p[b] * ({_literal(_mel_row(1, 5, 16))})[b] for b in range(1, 10)]), 5) as value from p""")
def mel(spark, d):
    return _shape(spark, d, signal.mel(SR, n_fft=16, hop=8, n_mels=5)(F.col("waveform")))


def _cqt_row(k, fmin, per_octave):
    """The real part of a bin's kernel, where it meets the signal at the first frame."""
    f = fmin * 2 ** (k / per_octave)
    n = int(np.ceil(SR / (2 ** (1 / per_octave) - 1) / f))
    return [(0.5 - 0.5 * np.cos(2 * np.pi * (j + 1) / (n + 1))) * np.cos(2 * np.pi * f / SR * (j - n / 2)) / n for j in range(n // 2 + 1, n)]


@query(f"select vec_id, 24::bigint as bins, 4::bigint as frames, round(list_sum([embedding[k]::double * ({_literal(_cqt_row(1, 4.0, 6))})[k] for k in range(1, {len(_cqt_row(1, 4.0, 6)) + 1})]), 5) as value from embeddings")
def cqt(spark, d):
    return _shape(spark, d, signal.cqt(SR, hop=16, fmin=4.0, n_bins=12, per_octave=6)(F.col("waveform")))


@query()
def f0_yin(spark, d):
    return signals(spark, d).select("vec_id", F.posexplode(signal.f0(SR, fmin=4.0, fmax=20.0, frame=32, hop=16)(F.col("waveform"))).alias("frame", "hz")).select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("hz", 4).alias("hz"))


@query()
def embedding_views(spark, d):
    views = signal.views(F.col("waveform"), signal.embedding(17, 4, 16), [t.polarity, t.reverse])
    return signals(spark, d).select("vec_id", views.alias("v")).select("vec_id", F.size("v").cast("long").alias("views"), F.round(F.col("v")[0][0][0], 5).alias("first"), F.round(F.col("v")[1][0][0], 5).alias("second"))


def _buckets(spark, d, dims):
    rows = signals(spark, d)
    model = cluster.fit(rows, "waveform", 8, "vec_id", dims)
    return cluster.index(cluster.assign(rows, model, "waveform"), "vec_id").groupBy("value").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"))


@query()
def kmeans_index(spark, d):
    return _buckets(spark, d, None)


@query()
def pca_kmeans(spark, d):
    return _buckets(spark, d, 8)


def _drawn_sql(y, count, seed):
    """With u, the numbers that a row draws."""
    return _sql(y, f", [cast(cast('0x' || md5('{seed}:' || vec_id || '/' || k)[1:13] as bigint) as double) / 4503599627370496.0::double for k in range(0, {count})] as u")


@query()
def xform_phase_mangle(spark, d):
    return _some(spark, d, signal.phase_mangle(SR, 2, 20)(F.col("waveform"), F.col("vec_id"), 21))


@query()
def xform_random_eq(spark, d):
    return _some(spark, d, signal.random_eq(SR * 100)(F.col("waveform"), F.col("vec_id"), 22))


@query()
def xform_random_distort(spark, d):
    return _some(spark, d, signal.random_distort(SR * 100)(F.col("waveform"), F.col("vec_id"), 23))


@query()
def xform_random_stretch(spark, d):
    rows = signals(spark, d).select("vec_id", signal.random_stretch(SR * 10)(F.col("waveform"), F.col("vec_id"), 24).alias("y"))
    return rows.select("vec_id", F.size("y").cast("long").alias("n"), F.round(F.array_max("y"), 6).alias("top"))


@query(_drawn_sql("list_concat([w[f // 2 + 2 - i] for i in range(1, f // 2 + 1)], w, [w[64 - f - i] for i in range(1, f - f // 2 + 1)])", 2, 25).replace(" from embeddings)", " from embeddings), d as (select *, (u[1] * 9) as dl, cast(floor(u[1] * 9) as bigint) + 2 as f, pow(u[2] * 2 - 1, 3.0::double) as mix from x), g as (select *, [x[n + f] + mix * (x[n + 1] * (1 - (dl - f + 1)) + x[n] * (dl - f + 1)) for n in range(1, 65 - f)] as w from d)").replace("as y from x)", "as y from g)"))
def xform_random_delay(spark, d):
    u = lambda k: uniform(F.concat_ws("/", F.col("vec_id"), F.lit(k)), 25)
    return _some(spark, d, t.random_delay(F.col("waveform"), u(0), u(1), 10))


@query(_sql("[x[i] + sqrt(list_sum([v * v for v in x]) / 64 / (list_sum([v * v for v in x[1:10]]) / 10)) * pow(10.0::double, -0.3::double) * x[(i - 1) % 10 + 1] for i in range(1, 65)]"))
def xform_background(spark, d):
    """The signal's own first ten samples as a noise 6 dB below it."""
    return _some(spark, d, t.mixed(F.col("waveform"), F.slice("waveform", 1, 10), F.lit(6.0)))


@query()
def xform_time_stretch(spark, d):
    return _some(spark, d, signal.time_stretch(1.25, 16)(F.col("waveform")))


@query()
def xform_pitch_shift(spark, d):
    return _some(spark, d, signal.pitch_shift(3, 16)(F.col("waveform")))


@query()
def f0_pyin(spark, d):
    rows = signals(spark, d).select("vec_id", F.posexplode(signal.f0(SR, "pyin", fmin=4.0, fmax=20.0, frame=32, hop=16)(F.col("waveform"))).alias("frame", "hz"))
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("hz", 4).alias("hz"))


@query()
def notes_decoded(spark, d):
    """Signals as activations of 88 pitches over time: notes by label."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(87)), lambda p: F.abs(F.get(F.col("waveform"), F.pmod(F.floor(i / 15) * 7 + p, F.lit(64)).cast("int"))).cast("double") * 4))
    rows = signals(spark, d).where("label is not null").select("vec_id", frames.alias("f"))
    found = rows.select("vec_id", F.explode(notes.decoded(F.col("f"), F.col("f"), None, False, least=8)).alias("n"))
    return found.groupBy("vec_id").agg(F.count("*").alias("n_notes"), F.min("n.pitch").alias("lowest"), F.round(F.sum("n.amplitude"), 4).alias("amplitude"))
