"""Batches of files that several jobs share: each input once, after stops, crashes and late returns."""

from pyspark.sql import functions as F

from sonolith.sources import batch
from sonolith.store import Store


def work(rows):
    return rows.select("name", (F.length("name") * 2).alias("n"))


def test_two_jobs_write_each_output_once(spark, tmp_path):
    inputs = spark.range(50).select(F.concat(F.lit("f"), "id").alias("name"))
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a, b = batch.claim(one, inputs, "name", "a", 20), batch.claim(two, inputs, "name", "b", 20)
    assert a.count() == b.count() == 20 and a.intersect(b).isEmpty()
    assert batch.finish(two, b, "name", work(b), "b") and batch.finish(one, a, "name", work(a), "a")
    assert batch.run(one, inputs, "name", work, batch=7) == 2 and batch.run(two, inputs, "name", work) == 0
    got = one.read("outputs")
    assert got.count() == 50 and got.select("name").distinct().count() == 50
    more = inputs.unionByName(spark.createDataFrame([("new",), ("new",)], "name string"))
    assert batch.run(two, more, "name", lambda rows: work(rows.distinct())) == 1 and two.read("outputs").count() == 51


def test_claims_of_dead_jobs_run_out(spark, tmp_path):
    inputs = spark.range(5).select(F.col("id").cast("string").alias("name"))
    store, clock = Store(spark, str(tmp_path / "s")), [1000.0]
    dead = batch.claim(store, inputs, "name", "dead", 5, 60.0, lambda: clock[0])
    assert batch.claim(store, inputs, "name", "b", 5, 60.0, lambda: clock[0]) is None
    clock[0] += 61
    mine = batch.claim(store, inputs, "name", "b", 5, 60.0, lambda: clock[0])
    assert mine.count() == 5 and batch.finish(store, mine, "name", work(mine), "b")
    assert not batch.finish(store, dead, "name", work(dead), "dead")
    assert store.read("outputs").count() == 5 and {r.job for r in store.read("done").collect()} == {"b"}


def test_a_finish_that_comes_second_is_carried_over(spark, tmp_path):
    inputs = spark.range(6).select(F.col("id").cast("string").alias("name"))
    store = Store(spark, str(tmp_path / "s"))
    a, b = batch.claim(store, inputs, "name", "a", 3), batch.claim(store, inputs, "name", "b", 3)
    late = store.change("finish")
    late.append("outputs", work(a))
    late.append("done", a.select(F.col("name").alias("key"), F.lit("a").alias("job")))
    assert batch.finish(store, b, "name", work(b), "b")
    late.rebased().commit({})
    assert store.read("outputs").count() == 6 and store.read("done").count() == 6
