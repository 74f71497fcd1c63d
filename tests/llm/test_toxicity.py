"""Toxicity: held-out accuracy on an invented corpus, empty cases, columns."""

import random
import zlib

import pytest

from sonolith.llm import toxicity as t


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(3)
    words = [a + b for a in "ba ce di fo gu ha ki lo me nu".split() for b in "ra se ti vo xu ya zil mon pel dor".split()]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["awful", "rotten", "vile"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(2_000, None, None, None, None), (2_001, "", "en", "", 0), (2_002, "vile " * 30_000, "xx", "", 0), (None, "vile rotten awful", "en", "", 0), (7, rows[7][1], "en", "s", 1)]
    path = tmp_path_factory.mktemp("tox")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict((i, x) for i, _, x in labels), len(rows)


def test_query(spark, corpus):
    path, labels, n = corpus
    got = t.op6_toxicity(spark, path).collect()
    assert len(got) == n
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    assert right > 0.97
    assert {r.doc_id: r.predicted for r in got}[2_002] == 1


def test_nothing_to_learn_from(spark, corpus):
    docs = spark.read.parquet(corpus[0] + "/documents.parquet")
    for labels in (spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int")):
        model = t.fit(docs, labels)
        assert {r.score for r in t.toxicity(docs.limit(9), model).collect()} == {0.0}
    assert t.toxicity(docs.limit(0), model).count() == 0
    assert t.without_toxic(docs, model).count() == docs.count()


def test_calibration_keeps_the_share_of_labels(spark):
    """One in ten is toxic and the classes overlap: scores add up to that share, however few rows may train."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 10 == 0
        text = [f"word{rng.randrange(300)}" for _ in range(20)]
        if toxic or rng.random() < 0.15:
            text[rng.randrange(20)] = "vile"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_rows=600)
    scores = {r.doc_id: r.score for r in t.toxicity(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 2}
    assert abs(sum(scores.values()) / len(scores) - 0.1) < 0.02
    assert sum(s >= 0.7 for s in scores.values()) < 0.02 * len(scores)  # "vile" is toxic in less than half of its texts


def test_languages_are_bounded(spark, corpus, monkeypatch):
    """Rare languages share a threshold, so a column with as many values as rows makes neither the driver nor the plan grow."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{corpus[0]}/{x}.parquet") for x in ("documents", "labels"))
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("l"), "doc_id")).otherwise("en"))
    monkeypatch.setattr(t, "LANGUAGES", 5)
    model = t.fit(dirty, labels)
    assert len(model.thresholds) <= 6 and "en" in model.thresholds
    assert t.toxicity(dirty, model).count() == docs.count()


def test_responses_against_plain_loops():
    """The largest response of every filter, place by place; texts shorter than a filter are padded at the end."""
    import numpy as np

    rng = np.random.default_rng(1)
    model = t.train(["good words here", "vile words there", "vile thing", "good thing"], [0, 1, 1, 0], steps=3, least=1)
    for n in (0, 1, 2, 3, 7, 50):
        ids = np.stack([rng.integers(0, t.BUCKETS - 1, n) for _ in range(3)], 1).astype(np.int32).reshape(n, 3)
        x = [model.whole[a] + model.stem[b] + model.stem[c] for a, b, c in ids] + [np.zeros(12, np.float32)] * (2 if n else 3)
        want, k = [], 0
        for f in model.filters:
            for c in range(f.shape[2]):
                every = [sum(float(x[i + j] @ f[j, :, c]) for j in range(f.shape[0])) for i in range(len(x) - 2)]
                want.append(max(0.0, max(every) + float(model.offsets[k])))
                k += 1
        assert np.allclose(t.responses(model, ids), want, atol=1e-5)


def test_training_rows_are_bounded_by_bytes_and_do_not_depend_on_order(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus[0]}/{x}.parquet") for x in ("documents", "labels"))
    a, b = (t.fit(d, labels, max_bytes=600) for d in (docs, docs.orderBy("text").repartition(5)))
    assert (a.whole == b.whole).all() and a.thresholds == b.thresholds
    assert t.fit(docs, labels, max_bytes=0).constant
