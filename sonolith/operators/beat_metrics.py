"""How well found beats agree with true ones, by track: F-measure, Cemgil's score, continuity.

Matching is within islands of beats, continuity by the nearest true beat of each found one: sorts by track and time,
no pairs. Beats are rows (track, time); a track without beats on one side scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a beat may be off, the width of Cemgil's bell, shares of a period that phase and period may be off,
#: seconds at a track's begin that do not count.
TOLERANCE, BELL, PHASE, PERIOD, LEAD_IN = 0.07, 0.04, 0.175, 0.175, 5.0


def trimmed(beats: DataFrame, time: str, least: float = LEAD_IN) -> DataFrame:
    return beats.where(F.col(time) >= least)


def _own(beats: DataFrame, by: str, time: str) -> DataFrame:
    return beats.select(F.col(by).alias("track"), F.col(time).cast("double").alias("t")).where("track is not null and t is not null")


def _counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    sides = truth.select("track", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(found.select("track", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return sides.groupBy("track").agg(F.sum("a").alias("n_truth"), F.sum("b").alias("n_found"))


def _matched(events: Column, window: float) -> Column:
    """The largest number of pairs of sorted (t, side) that are at most ``window`` apart, each event in one pair.

    Events that wait for a partner are all of one side; the oldest goes first, and those that are too old are dropped.
    """
    start = F.struct(F.lit(0).alias("side"), F.array().cast("array<double>").alias("waiting"), F.lit(0).alias("n"))

    def step(s: Column, e: Column) -> Column:
        live = F.filter(s["waiting"], lambda t: e["t"] - t <= window)
        partner = (s["side"] != e["side"]) & (F.size(live) > 0)
        joins = (s["side"] == e["side"]) & (F.size(live) > 0)
        queue = F.when(partner, F.slice(live, 2, 1_000_000)).when(joins, F.concat(live, F.array(e["t"]))).otherwise(F.array(e["t"]))
        return F.struct(F.when(partner, s["side"]).otherwise(e["side"]).alias("side"), queue.alias("waiting"), (s["n"] + partner.cast("int")).alias("n"))

    return F.aggregate(events, start, step, lambda s: s["n"])


def f_measure(truth: DataFrame, found: DataFrame, by: str, time: str, window: float = TOLERANCE) -> DataFrame:
    """track, n_truth, n_found, n_matched, precision, recall, f_measure. A run of beats with no gap over ``window`` is matched at once."""
    truth, found = _own(truth, by, time), _own(found, by, time)
    both = truth.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(2)))
    w = Window.partitionBy("track").orderBy("t", "side")
    gap = F.coalesce((F.col("t") - F.lag("t").over(w) > window).cast("int"), F.lit(0))
    islands = both.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w))
    paired = islands.groupBy("track", "island").agg(_matched(F.array_sort(F.collect_list(F.struct("t", "side"))), window).alias("n"))
    counts = _counts(truth, found).join(paired.groupBy("track").agg(F.sum("n").alias("n_matched")), "track")
    p, r = (F.coalesce(F.try_divide("n_matched", n), F.lit(0.0)) for n in ("n_found", "n_truth"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f_measure", F.coalesce(F.try_divide(F.lit(2.0) * F.col("n_matched"), F.col("n_found") + F.col("n_truth")), F.lit(0.0)))


#: The variations: as it is, between the beats, twice as many, every other one from the first and from the second.
AS_IS, BETWEEN, DOUBLE, ODD, EVEN = range(5)


def variations(truth: DataFrame) -> DataFrame:
    """track, variation, k, t: true beats, and what a listener may tap in their place."""
    w = Window.partitionBy("track").orderBy("t")
    numbered = truth.withColumn("k", F.row_number().over(w) - 1).withColumn("next", F.lead("t").over(w))
    middle = (F.col("t") + F.col("next")) / 2
    other = (F.col("k") % 2 == 0).cast("int")
    kind = lambda v, k, t: F.struct(v.alias("variation"), k.cast("int").alias("k"), t.alias("t"))
    k, t = F.col("k"), F.col("t")
    kinds = F.array(kind(F.lit(AS_IS), k, t), kind(F.lit(BETWEEN), k, middle), kind(F.lit(DOUBLE), k * 2, t), kind(F.lit(DOUBLE), k * 2 + 1, middle), kind(F.when(other == 1, ODD).otherwise(EVEN), F.floor(k / 2), t))
    return numbered.select("track", F.explode(kinds).alias("v")).select("track", "v.*").where("t is not null")


def _nearest(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each found beat of each variation with the nearest true one (k, at) and those before and after it; the first of equally near ones."""
    v = Window.partitionBy("track", "variation")
    same = Window.partitionBy("track", "variation", "t")
    in_order = v.orderBy("k")
    known = truth.withColumn("prev", F.lag("t").over(in_order)).withColumn("next", F.lead("t").over(in_order)).withColumn("rn", F.row_number().over(same.orderBy("k"))).where("rn = 1").drop("rn")
    beat = known.select("track", "variation", "t", F.lit(0).alias("side"), F.struct("k", F.col("t").alias("at"), "prev", "next").alias("beat"))
    f = Window.partitionBy("track").orderBy("t")
    numbered = found.withColumn("m", F.row_number().over(f) - 1).withColumn("before", F.lag("t").over(f)).withColumn("after", F.lead("t").over(f))
    asked = numbered.withColumn("variation", F.explode(F.array(*map(F.lit, range(5))))).withColumn("side", F.lit(1))
    both = beat.unionByName(asked, allowMissingColumns=True)
    w = v.orderBy("t", "side")
    low = F.last("beat", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("beat", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("low", low).withColumn("high", high).where("side = 1")
    first = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull() | (F.col("t") - F.col("low.at") <= F.col("high.at") - F.col("t")), F.col("low")).otherwise(F.col("high"))
    return both.withColumn("near", first).where("near is not null").select("track", "variation", "m", "t", "before", "after", "near.*")


def cemgil(truth: DataFrame, found: DataFrame, by: str, time: str, sigma: float = BELL) -> DataFrame:
    """track, cemgil, cemgil_best: true beats weigh by how near the nearest found one is, over the mean of both numbers; best of all variations."""
    truth, found = _own(truth, by, time), _own(found, by, time)
    tapped = variations(truth)
    v = Window.partitionBy("track", "variation").orderBy("t", "side")
    asked = tapped.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(0)).withColumn("variation", F.explode(F.array(*map(F.lit, range(5))))).withColumn("k", F.lit(None).cast("int")))
    hit = F.when(F.col("side") == 0, F.col("t"))
    low = F.last(hit, True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(hit, True).over(v.rowsBetween(0, Window.unboundedFollowing))
    away = F.least(F.col("t") - low, high - F.col("t"))
    near = asked.withColumn("away", away).where("side = 1").groupBy("track", "variation").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.exp(-(F.col("away") * F.col("away")) / (2 * sigma * sigma))), F.lit(0.0)).alias("s"))
    scored = near.join(found.groupBy("track").agg(F.count("*").alias("n_found")), "track").withColumn("score", F.col("s") / (0.5 * (F.col("n") + F.col("n_found"))))
    best = scored.groupBy("track").agg(F.max(F.when(F.col("variation") == AS_IS, F.col("score"))).alias("cemgil"), F.max("score").alias("cemgil_best"))
    return _zeros(truth, found, best, ["cemgil", "cemgil_best"])


def _zeros(truth: DataFrame, found: DataFrame, scored: DataFrame, names: list[str]) -> DataFrame:
    tracks = truth.select("track").unionByName(found.select("track")).distinct()
    return tracks.join(scored, "track", "left").select("track", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def continuity(truth: DataFrame, found: DataFrame, by: str, time: str, phase: float = PHASE, period: float = PERIOD) -> DataFrame:
    """track, cml_c, cml_t, aml_c, aml_t: the longest run of right beats and all of them, over the larger number of beats; at the true level and at the best variation.

    A found beat is right if it is near enough to the nearest true one and its period to that one's, both as shares of the true period;
    a true beat serves the first right one. Fewer than two beats on a side score 0.
    """
    truth, found = _own(truth, by, time), _own(found, by, time)
    ahead = (F.col("m") == 0) | (F.col("k") == 0)
    back = F.col("at") - F.col("prev")
    true_period = F.when(ahead, F.coalesce(F.col("next") - F.col("at"), back)).otherwise(back)
    own_period = F.when(ahead, F.coalesce(F.col("after") - F.col("t"), F.col("t") - F.col("before"))).otherwise(F.col("t") - F.col("before"))
    fits = (F.abs(F.try_divide(F.abs(F.col("t") - F.col("at")), true_period)) < phase) & (F.abs(1 - F.try_divide(own_period, true_period)) < period)
    tapped = variations(truth)
    judged = _nearest(tapped, found).withColumn("fits", F.coalesce(fits, F.lit(False)))
    served = F.row_number().over(Window.partitionBy("track", "variation", "k", "fits").orderBy("m"))
    judged = judged.withColumn("right", F.col("fits") & (served == 1))
    in_order = Window.partitionBy("track", "variation").orderBy("m")
    runs = judged.withColumn("run", F.sum((~F.col("right")).cast("int")).over(in_order)).groupBy("track", "variation", "run").agg(F.count(F.when(F.col("right"), 1)).alias("n"))
    best = runs.groupBy("track", "variation").agg(F.max("n").alias("longest"), F.sum("n").alias("all"))
    sizes = tapped.groupBy("track", "variation").agg(F.count("*").alias("n_var"))
    scored = best.join(sizes, ["track", "variation"]).join(_counts(truth, found), "track").where("n_truth > 1 and n_found > 1")
    over = F.greatest("n_var", "n_found")
    scored = scored.withColumn("c", F.col("longest") / over).withColumn("t", F.col("all") / over)
    own = lambda c: F.max(F.when(F.col("variation") == AS_IS, F.col(c)))
    out = scored.groupBy("track").agg(own("c").alias("cml_c"), own("t").alias("cml_t"), F.max("c").alias("aml_c"), F.max("t").alias("aml_t"))
    return _zeros(truth, found, out, ["cml_c", "cml_t", "aml_c", "aml_t"])
