"""Language ID: forward-backward and gradients against plain sums, held-out accuracy, switches within a text, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest

from sonolith.llm import crf_language as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(3)
    for k in (2, 3):
        sizes = [1, 4, 2, 5]
        scores, t, s = rng.normal(size=(sum(sizes), k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
        heads, want, at = np.zeros(sum(sizes), bool), [], 0
        for n in sizes:
            heads[at] = True
            mass = np.zeros((n, k))
            for path in itertools.product(range(k), repeat=n):
                p = np.exp(s[path[0]] + sum(scores[at + i, x] for i, x in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
                for i, x in enumerate(path):
                    mass[i, x] += p
            want.append(mass / mass.sum(axis=1, keepdims=True))
            at += n
        for lane in (1, 2, 3, 5, 100):
            assert np.allclose(c.posteriors(scores, heads, t, s, lane), np.concatenate(want), atol=1e-9)


def test_features_are_affixes_and_grams():
    of, rows = c.features(["Haus", "a", "haus"], {"haus": (c.BUCKETS + 1,)})
    sets = [sorted(rows[of == k].tolist()) for k in range(3)]
    assert sets[0] == sets[2] and c.BUCKETS + 1 in sets[0] and c.BUCKETS + 1 not in sets[1]
    # ^haus$: 5 pairs and 4 triples, affixes of 2 to 4 signs at either end, the word, the lexicon
    assert len(sets[0]) == 5 + 4 + 6 + 1 + 1 and len(sets[1]) == 2 + 1 + 2 * 2 + 1


def _text(rng, lang, n):
    parts = {"xa": "bel dor kin mos ta re", "xb": "sch ung wei lich fe re", "xc": "çon été ñu mos ão li"}[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    rows = [(k, _text(rng, lang, rng.randrange(4, 90)), lang, "s", 1) for k in range(600) for lang in [rng.choice(["xa", "xa", "xb", "xc"])]]
    rows += [(1000, None, "xa", None, None), (1001, "", "xb", "", 0), (1002, "12 _ ² … \n", "xa", "", 0), (None, _text(rng, "xb", 50), "xb", "", 0), (1003, _text(rng, "xc", 400_000), None, "", 0), (1004, "rare", "only once", "", 0), (1005, "été ", "xc", "", 0), (3, rows[3][1], rows[3][2], "s", 1)]
    path = tmp_path_factory.mktemp("crf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_query(spark, corpus):
    path, rows = corpus
    got = c.op11_language_id(spark, path).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1003].lang_pred == by_id[1005].lang_pred == "xc" and by_id[None].lang_pred == "xb"
    assert {r.lang_pred for r in got} <= {"xa", "xb", "xc", "und"}


def test_held_out_rows_and_other_columns_teach_nothing(spark, corpus):
    docs = spark.read.parquet(corpus[0] + "/documents.parquet")
    model = c.fit(docs)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(c.fold() == 1, "xz").otherwise(F.col("lang"))).withColumn("source", F.lit("q")).withColumn("words", F.lit(1)).repartition(3)
    again = c.fit(other)
    assert again.labels == model.labels and (again.weights == model.weights).all() and again.lexicon == model.lexicon


def test_switches_within_a_text(spark, corpus):
    docs = spark.read.parquet(corpus[0] + "/documents.parquet")
    model, rng = c.fit(docs), random.Random(1)
    parts = [("xa", _text(rng, "xa", 25)), ("xb", _text(rng, "xb", 20)), ("xc", _text(rng, "xc", 30)), ("xa", _text(rng, "xa", 25))]
    text = ", ".join(t for _, t in parts)
    found = c.switches(spark.createDataFrame([(1, text), (2, None), (3, "1 2")], "doc_id long, text string"), model).collect()
    spans = next(r.spans for r in found if r.doc_id == 1)
    assert [s.lang for s in spans] == [x for x, _ in parts]
    right = sum(len(set(range(s.start, s.end)) & set(range(text.index(t), text.index(t) + len(t)))) for s, (_, t) in zip(spans, parts))
    assert right / len(text) > 0.95 and sum(s.n_words for s in spans) == 100
    assert all(not r.spans for r in found if r.doc_id != 1)
    # transitions are learnt: staying is likelier than switching
    assert all(model.transitions[i, i] > model.transitions[i, j] for i in range(3) for j in range(3) if i != j)


def test_long_texts_in_pieces_like_whole_ones(spark, corpus, monkeypatch):
    docs = spark.read.parquet(corpus[0] + "/documents.parquet")
    model = c.fit(docs)
    text = _text(random.Random(6), "xb", 3000)
    monkeypatch.setattr(c, "PIECE", 500)
    assert "".join(p for _, p in c._pieces(text)) == text
    assert [w for _, p in c._pieces(text) for w in c._words(p)] == c._words(text)
    assert [w for _, p in c._pieces("a" * 2000) for w in c._words(p)] == ["a" * 2000]


def test_nothing_or_one_language_to_learn(spark):
    docs = spark.createDataFrame([(k, "ein wort", None, "", 0) for k in range(9)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in c.languages(docs, c.fit(docs)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(k, "ein wort", "de", "", 0) for k in range(60)] + [(99, "7", "de", "", 0)], SCHEMA)
    model = c.fit(one)
    assert {(r.lang_pred, r.score) for r in c.languages(one, model).collect()} == {("de", 1.0), ("und", 0.0)}
    assert c.languages(one.limit(0), model).count() == 0 and c.fit(one.limit(0)).labels == []
