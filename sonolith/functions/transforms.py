"""Augmentations that are sample-wise or move samples: Spark expressions on array columns.

Random ones take uniform columns (``keys.uniform`` of a key and a seed), so a row's result
does not depend on partitioning or engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, centred, peak
from .keys import shuffle_hash, uniform


def _d(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _indexed(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(x, f)


def _before(x: Column) -> Column:
    """Each sample's predecessor, 0 before the first."""
    return F.slice(F.concat(F.array(F.lit(0.0)), _d(x)), F.lit(1), F.size(x))


def gain(x: Column, db: Column) -> Column:
    """Times 10^(db/20), then divided by the peak where that is above 1."""
    loud = F.transform(x, lambda v: v.cast("double") * F.pow(F.lit(10.0), db / 20))
    return bound(loud, lambda y: bound(F.greatest(peak(y), F.lit(1.0)), lambda top: F.transform(y, lambda v: v / top)))


def gain_plain(x: Column, db: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * F.pow(F.lit(10.0), db / 20))


def normalise(x: Column, max_db: float = 30.0) -> Column:
    """To a peak of 1, by at most ``max_db``; silence stays."""
    factor = lambda top: F.when(top > 0, F.least(1.0 / top, F.lit(10 ** (max_db / 20)))).otherwise(1.0)
    return bound(peak(x).cast("double"), lambda top: bound(factor(top), lambda k: F.transform(x, lambda v: v.cast("double") * k)))


def pre_emphasis(x: Column, c: float = 0.97) -> Column:
    return F.zip_with(_d(x), _before(x), lambda a, b: a - F.lit(c) * b)


def derivative(x: Column) -> Column:
    return F.zip_with(_d(x), _before(x), lambda a, b: (a - b) * 0.5)


def reverse(x: Column) -> Column:
    return F.reverse(x)


def crop(x: Column, size: int, u: Column) -> Column:
    """``size`` samples from a random start."""
    return F.slice(x, F.floor(u * (F.size(x) - size + 1)).cast("int") + 1, F.lit(size))


def clip(x: Column, low: float = -0.9, high: float = 0.9) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(v.cast("double"), F.lit(high)), F.lit(low)))


def clip_share(x: Column, share: float) -> Column:
    """Clipping distortion: limits at the sample of rank share/2 from either end. Sorted once."""
    k = F.floor(F.lit(share / 2) * F.size(x)).cast("int")
    ends = lambda r: F.struct(F.element_at(r, k + 1).alias("low"), F.element_at(r, F.size(r) - k).alias("high"))
    return F.when(F.size(x) > 0, bound(bound(F.array_sort(_d(x)), ends), lambda e: F.transform(x, lambda v: F.greatest(F.least(v.cast("double"), e["high"]), e["low"])))).otherwise(_d(x))


def tanh(x: Column, drive: float = 4.0) -> Column:
    return F.transform(x, lambda v: F.tanh(v.cast("double") * drive))


def polarity(x: Column) -> Column:
    return F.transform(x, lambda v: -v.cast("double"))


def mute(x: Column, key: Column | None = None, seed: int = 0, std: float = 0.0) -> Column:
    """Zeros, or noise of that deviation."""
    if not std:
        return F.transform(x, lambda _: F.lit(0.0))
    return F.transform(x, lambda _, i: _normal(key, i, seed) * std)


def time_mask(x: Column, start: Column, size: int) -> Column:
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + size), 0.0).otherwise(v.cast("double")))


def shift(x: Column, by: Column, roll: bool = True) -> Column:
    """Later by that many samples; what leaves comes back in front, or zeros do."""
    n = F.size(x)
    k = F.pmod(by, n)
    rolled = F.concat(F.slice(_d(x), n - k + 1, k), F.slice(_d(x), F.lit(1), n - k))
    return rolled if roll else F.transform(rolled, lambda v, i: F.when(i < k, 0.0).otherwise(v))


def delay(x: Column, samples: Column, mix: Column) -> Column:
    """Comb filter: x[n] + mix * x[n - samples], of a fraction by the line through the next two whole delays; shorter by the
    longer of these, and brought back to the old length by mirrored ends."""
    first = F.floor(samples).cast("int") + 1
    part, n = samples - first, F.size(x)

    def wet(y: Column) -> Column:
        late = F.zip_with(F.slice(y, F.lit(2), n - first - 1), F.slice(y, F.lit(1), n - first - 1), lambda a, b: a * (1 - part) + b * part)
        return bound(F.zip_with(F.slice(y, first + 2, n), late, lambda a, b: a + mix * b), lambda z: centred(z, n, "reflect"))

    return F.when(n > first + 1, bound(_d(x), wet)).otherwise(_d(x))


def random_delay(x: Column, u: Column, v: Column, longest: int = 1024) -> Column:
    """By up to ``longest`` samples, mixed by the cube of a number from -1 to 1."""
    return delay(x, u * (longest - 1), F.pow(v * 2 - 1, F.lit(3.0)))


def bitcrush(x: Column, bits: int = 5) -> Column:
    steps = float(2 ** (bits - 1))
    return F.transform(x, lambda v: F.round(v.cast("double") * steps) / steps)


def aliasing(x: Column, every: int) -> Column:
    """Hold every n-th sample."""
    return F.transform(x, lambda _, i: F.element_at(x, (i - i % every).cast("int") + 1).cast("double"))


def gain_transition(x: Column, db_from: Column, db_to: Column) -> Column:
    last = F.greatest(F.size(x) - 1, F.lit(1))
    return F.transform(x, lambda v, i: v.cast("double") * F.pow(F.lit(10.0), (db_from + (db_to - db_from) * i / last) / 20))


def repeat_part(x: Column, start: Column, size: int, times: int) -> Column:
    """A part again and again in its place, cut to the old length."""
    part = F.slice(x, start + 1, F.lit(size))
    longer = F.concat(F.slice(x, F.lit(1), start), *[part] * (times + 1), F.slice(x, start + size + 1, F.size(x)))
    return F.slice(longer, F.lit(1), F.size(x))


def adjust_duration(x: Column, size: int) -> Column:
    zero = F.lit(0).cast("float")
    return F.when(F.size(x) >= size, F.slice(x, F.lit(1), F.lit(size))).otherwise(F.concat(x, F.array_repeat(zero, F.lit(size) - F.size(x))))


def _unit(key: Column, i: Column, seed: int | str) -> Column:
    return F.conv(F.substring(shuffle_hash(F.concat_ws("/", key, i), seed), 1, 13), 16, 10).cast("double") / float(16**13)


def _normal(key: Column, i: Column, seed: int) -> Column:
    u, v = _unit(key, i, f"{seed}a"), _unit(key, i, f"{seed}b")
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-16)))) * F.cos(v * 6.283185307179586)


def add_noise(x: Column, key: Column, seed: int = 0, std: float = 1e-5) -> Column:
    return F.transform(x, lambda v, i: v.cast("double") + _normal(key, i, seed) * std)


def dequantise_noise(x: Column, key: Column, seed: int = 0, bits: int = 16) -> Column:
    return F.transform(x, lambda v, i: v.cast("double") + _unit(key, i, seed) / float(2**bits))


def one_hot(value: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == value).cast("int"))


def maybe(x: Column, changed: Column, key: Column, p: float | None, seed: int) -> Column:
    """The change with probability p, drawn from key and seed; None always."""
    return changed if p is None else F.when(uniform(key, seed) < p, changed).otherwise(x)


def compose(x: Column, steps: list[tuple[Callable[[Column], Column], float | None]], key: Column, seed: int = 0) -> Column:
    """One after the other, each with its own probability; step k draws by (seed, k)."""
    for k, (f, p) in enumerate(steps):
        x = maybe(_d(x), f(x), key, p, seed * 1000 + k)
    return x


def short_noises(x: Column, key: Column, seed: int = 0, every: int = 4000, size: int = 800, db: float = -20.0) -> Column:
    """A burst of noise in each stretch of ``every`` samples, at a random place in it, fading in and out."""

    def burst(v: Column, i: Column) -> Column:
        stretch = F.floor(i / every).cast("int")
        at = i - stretch * every - F.floor(_unit(key, stretch, f"{seed}p") * max(1, every - size)).cast("int")
        fade = F.sin(F.least(F.greatest(at / float(size), F.lit(0.0)), F.lit(1.0)) * 3.141592653589793)
        return F.when((at >= 0) & (at < size), v.cast("double") + fade * _normal(key, i, seed) * 10 ** (db / 20)).otherwise(v.cast("double"))

    return F.transform(x, burst)


def mixed(x: Column, noise: Column, db: Column) -> Column:
    """Background noise at a level (signal to noise, by energy), repeated or cut to the signal's length."""
    energy = lambda y: F.aggregate(y, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(y)
    level = F.sqrt(F.try_divide(energy(x), energy(noise))) * F.pow(F.lit(10.0), -db / 20)
    usable = (F.size(noise) > 0) & level.isNotNull()
    return F.when(usable, bound(level, lambda k: bound(_d(noise), lambda y: F.transform(x, lambda v, i: v.cast("double") + k * F.get(y, F.pmod(i, F.size(y))))))).otherwise(_d(x))
