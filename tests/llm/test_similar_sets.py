"""Shingle sets: groups against brute force over all pairs."""

import random

import numpy as np

from sonolith.llm import similar_sets as s


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, t=0.8):
    """Ids that stay: the smallest of each component of the pairs of at least this similarity."""
    sets = [grams(x) for _, x in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a and not b or (a or b) and len(a & b) >= t * len(a | b) - 1e-9:
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def near(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(150):  # pairs on both sides of the limit
        words = [f"d{k}w{i}" for i in range(100)]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, near(rng, words, rng.choice([1, 2, 2, 3])))]
    base = [f"b{i}" for i in range(200)]
    rows += [(5000 + i, near(rng, base, rng.choice([1, 2, 4, 8]))) for i in range(60)]  # long runs, of members that differ too much
    line = [f"line{i}" for i in range(30)]
    rows += [(6000 + i, " ".join(line + [f"o{i}x{j}" for j in range(rng.choice([2, 9, 60]))])) for i in range(60)]  # a common passage
    return rows + [(7000, None), (7001, ""), (7002, "one"), (7003, "ONE"), (7004, "x " * 500), (7005, "x x x x x")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in s.representatives(df).collect()) == brute(rows)
    assert s.representatives(df.limit(0)).count() == 0


def test_pipeline_stage_finds_every_pair_at_the_limit(spark):
    """400 pairs just above 0.8, of which chains of 26 equal bits and 155 differing ones lost many."""
    import corpus_pipeline

    rows = []
    for k in range(400):
        words = [f"d{k}w{i}" for i in range(100)]
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(words[:30] + ["u"] + words[31:70] + ["v"] + words[71:]), "en", "s", 1)]
    assert len(grams(rows[0][1]) & grams(rows[1][1])) / len(grams(rows[0][1]) | grams(rows[1][1])) > 0.81
    kept = corpus_pipeline.stage_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 800, 2))


def test_rows_of_one_id(spark):
    import corpus_pipeline

    rows = [(1, "a text of one kind here", "en", "s", 1), (1, "quite another text that is there", "en", "s", 1), (1, "a text of one kind here", "en", "s", 1)]
    kept = corpus_pipeline.stage_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), "")
    assert sorted(r.text for r in kept.collect()) == sorted({r[1] for r in rows})


def test_common_shingles_last_changes_no_result():
    rng = np.random.default_rng(2)
    own = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    common = np.sort(rng.choice(own, 20, replace=False))
    keys = s.keys_of(own, common, 0.8)
    assert len(keys) == 11 and not set(keys.tolist()) & set(common.tolist())
    assert len(s.keys_of(own, own, 0.8)) == 11


def test_fingerprints_of_similar_sets_stay_within_the_limits():
    """Random sets at the limit of 0.8, of any size: none is lost, and the share of differing bits is as stated."""
    rng = np.random.default_rng(7)
    for n in (4, 5, 8, 12, 20, 22, 60, 300):
        most = s.LIMITS[0] if n < s.LARGE else s.LIMITS[1]
        differ = []
        for _ in range(150):
            apart = n // 9 if n > 8 else 0
            whole = rng.integers(0, 2**63, n + apart + (n == 4), dtype=np.uint64)
            a, b = whole[:n], whole[apart:]
            common = len(np.intersect1d(a, b))
            if s.similar(common, len(a), len(b), 0.8):
                differ.append(int(np.bitwise_count(s.fingerprint_of(a, s.WORDS, 1) ^ s.fingerprint_of(b, s.WORDS, 1)).sum()))
        assert differ and max(differ) <= most and np.mean(differ) <= 256 * s.DIFFER[n >= s.LARGE] * 1.05


def test_large_families_go_in_pairs_of_blocks(spark, monkeypatch):
    """A family that is cut into blocks links what it links as a whole."""
    monkeypatch.setattr(s, "BLOCK", 25)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, near(rng, base, rng.choice([1, 2, 3, 4, 6]))) for i in range(160)]
    assert sorted(r.doc_id for r in s.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_the_ring_finds_near_copies_without_the_sets_keys(spark):
    """Candidates come from pigeonring keys of the fingerprints: near copies are linked though no key of their sets is there."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = [f"d{k}w{i}" for i in range(2000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, near(rng, words, 1))]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", s.row_key().alias("row"), "text")
    each = texts.mapInArrow(s._sets(5, 0.8, np.zeros(0, np.uint64)), "doc_id long, row long, node long, n int, keys array<long>, w array<long>").cache()
    w = {r.doc_id: (r.node, r.w[0]) for r in each.collect()}
    close = {tuple(sorted((w[i][0], w[i + 1][0]))) for i in range(0, 80, 2) if ((w[i][1] ^ w[i + 1][1]) & (2**64 - 1)).bit_count() <= 4}
    assert len(close) > 20
    found = s.links(each.withColumn("keys", F.array().cast("array<long>")), texts, 0.8, 5).collect()
    assert {tuple(sorted((r.a, r.b))) for r in found} == close
