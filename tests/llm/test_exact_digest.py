"""Exact digests: canonical forms, neighbours in the order of ids, clashes."""

import hashlib

from pyspark.sql import functions as F

from sonolith.llm import exact_digest as e


def test_canonical_forms(spark):
    groups = [["Straße  x", "STRASSE x ", "strasse\t\nx"], ["café", "cafe\u0301", "CAFÉ"], ["ﬁne", "FINE"], ["", " ", "\u00a0\u2003", None], ["a\u2028b", "A b"], ["①", "1"]]
    rows = [(g, t) for g, texts in enumerate(groups) for t in texts]
    df = spark.createDataFrame([(i, t, g, "x", "y") for i, (g, t) in enumerate(rows)], "doc_id long, text string, g int, fingerprint string, mark string")
    got = {r.doc_id: r.fingerprint for r in e.fingerprints(df).collect()}
    assert len(set(got.values())) == len(groups)
    for i, (g, _) in enumerate(rows):
        for j, (h, _) in enumerate(rows):
            assert (got[i] == got[j]) == (g == h)


def test_canonical_form_against_a_plain_one(spark):
    """NFKC, full case folding, NFKC, white space, letter by letter of several scripts."""
    import random
    import unicodedata

    rng = random.Random(2)
    letters = "aZ ßẞİıſﬀǅΣςé́ͅ①½  　	ÅÅ日カｶﾞ한ᄒ🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    want = [" ".join(nfkc(nfkc(x).casefold()).split()) for x in texts]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(e.canonical(F.col("t")).alias("f")).collect()]
    assert got == want


def test_positions_among_bounds(spark):
    for bounds in ([], [5], [9, 5, 0], list(range(4000, 0, -7))):
        got = [r.p for r in spark.range(-3, 4005, 4).select("id", e._position(F.col("id"), bounds).alias("p")).orderBy("id").collect()]
        assert got == [sum(b > v for b in bounds) for v in range(-3, 4005, 4)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    out = []
    for k, (d, _) in enumerate(order):
        x, n = texts[k], texts[(k + 1) % len(texts)]
        cut = len(x) // 3
        out.append((d, len(x), hashlib.sha256((x[: len(x) - cut] + n[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, tmp_path, tiny):
    rows = [(r.doc_id * 37 % 1009, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "no id"), (None, "abc" * 9), (5_000, None), (5_001, "é🙂x" * 9), (5_002, "y"), (5_002, "y"), (5_002, "another one"), (2**62, "far"), (-(2**62), "near " * 5_000)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, next_text string, range int").repartition(3)
    df.write.parquet(str(tmp_path / "t" / "documents.parquet"))
    got = e.op7_document_fingerprints(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got.select("doc_id", "n_chars", "edited_sha256").collect()), key=str) == expected(rows)
    assert got.where("(near_edited = 1) <> (fingerprint = edited_fingerprint)").count() == 0
    assert got.where("near_next = 1").count() >= 1
    df.limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert e.op7_document_fingerprints(spark, str(tmp_path / "e")).count() == 0


def test_clashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(e, "digest", lambda form: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, "b"), (5, "c")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in e.fingerprints(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3 and "same" in got.values()
