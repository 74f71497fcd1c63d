"""Positions of the whole concatenation."""

from sonolith.plans.registry import QUERIES


def test_every_position_is_looked_up(spark, small):
    n = [spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("customer", "supplier")]
    got = sorted((r.position, r.ds_id, r.local) for r in QUERIES["combined_member_all"](spark, small).collect())
    assert n[0] > 200 and n[1] and got == [(k, int(k >= n[0]), k - n[0] * (k >= n[0])) for k in range(sum(n))]


def test_draws_in_stretches_are_those_of_one_task(spark, monkeypatch):
    """Stretches between retirements that all tasks count, and ones that a task goes through, give the draws of a plain loop."""
    import hashlib

    from pyspark.sql import functions as F

    from sonolith.operators import combine

    def plain(sizes, batch, seed, normalise):
        live, least = [[x, n, 0] for x, n in sorted(sizes)], min(n for _, n in sizes) if normalise else 0
        out, k = [], 0
        while len(live) >= batch:
            c = live[int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) % len(live)]
            k += 1
            if c[1] - c[2] <= least:
                live.remove(c)
                continue
            c[2] += 1
            out.append((c[0], c[2]))
        return [(i // batch, i % batch, *x) for i, x in enumerate(out[: len(out) // batch * batch])]

    for sizes, batch, normalise, few in (([("a", 300), ("b", 30), ("c", 150), ("ä", 250)], 2, True, 120), ([("a", 40), ("b", 3), ("c", 41)], 1, False, 30), ([(f"k{k}", 5 + k % 7) for k in range(60)], 4, True, 90), ([("a", 5)], 2, True, 1)):
        df = spark.createDataFrame(sizes, "label string, n long")
        want = plain(sizes, batch, 7, normalise)
        for at_once in (200_000, few):
            monkeypatch.setattr(combine, "AT_ONCE", at_once)
            got = [tuple(r) for r in combine.draws(df, batch, 7, normalise).orderBy("batch_id", "slot").collect()]
            assert got == want, (sizes, at_once)
    rows = spark.range(600).select((F.col("id") % 3).alias("label"), "id")
    whole = combine.balanced_batches(rows, "label", "id", 2, keep_rest=True)
    assert whole.count() == 600 and whole.select("id").distinct().count() == 600


def test_balanced_splits_by_stretches_are_those_of_one_task(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from sonolith.operators import splits

    rng = random.Random(2)
    sizes = {f"k{k}": rng.choice([1, 1, 2, 3, 5, 9, 30, 80]) for k in range(90)} | {"": 4, "ä": 2}
    rows = spark.createDataFrame([(k, n) for k, n in sizes.items()], "label string, n int").select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    for ratios, tolerance in (({"a": 0.8, "b": 0.2}, 0.1), ({"a": 0.5, "b": 0.3, "c": 0.2}, 0.0), ({"a": 0.1, "b": 0.2}, 0.05), ({"x": 1.0}, 0.0)):
        found = []
        for at_once in (100_000, 0):
            monkeypatch.setattr(splits, "AT_ONCE", at_once)
            monkeypatch.setattr(splits, "BLOCK", 7)
            found.append(sorted((r.label, str(r.split), r.n) for r in splits.split_balanced(rows, "label", ratios, tolerance).groupBy("label", "split").agg(F.count("*").alias("n")).collect()))
        assert found[0] == found[1] and len(found[0]) == len(sizes)
