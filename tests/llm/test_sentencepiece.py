"""The transducer against the library, and round trips."""

import random

import numpy as np
import public_tokenizers
import sentencepiece

from sonolith.llm import sentencepiece_fst as f

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "Hello  world ", "\tA\n b", "é日本<s> ▁x", "▁a", "▁▁ ▁", "🙂👍🏽 ok", "x" * 500, " " * 333 + "a", "\x00\x7f", "İ ŉ Ǆ", "aaaaab " * 9, "don't 1234567 <0x41>", "ééé", "한국어 텍스트", "\r\n\r\n", "  ​", "ab" * 500, "=" * 100 + " == =", "aaa aaaa aaaaa aaaaaaa", " " * 20 + "the", "-" * 49, "b" * 48]


def ids_of(t, texts):
    return [list(memoryview(ids).cast("I")) for ids in t.encode(texts)]


def test_ids_and_texts_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = f.compiled(PATH)
    rng = random.Random(5)
    texts = list(HARD)
    for alphabet in ("etaoin shrdlu  ▁é日.,'ABC\n0127ß🙂", "ab=- "):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    outputs = t.decoder()
    for text, got in zip(texts, ids_of(t, texts)):
        want = library.encode(text)
        assert got == want, text
        assert f.decode(want, outputs) == library.decode(want), text


def test_very_long_texts_and_words():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = f.compiled(PATH)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(140_000)), "".join(rng.choice("abcd日=") for _ in range(30_000))]
    assert len(texts[0]) > 1_000_000
    assert ids_of(t, texts) == [library.encode(x) for x in texts]


def test_one_word_alone_and_in_batches():
    t = f.compiled(PATH)
    words = [" hello", " ▁", " ", " naïve", " 日本語"]
    assert t.paths(words) == [t.long_path(w) for w in words]


def test_pairs_that_may_follow_are_those_that_merging_leaves_apart():
    t = f.compiled(PATH)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, len(t.texts), (2, 3000))
    fits = [k for k in range(3000) if not t.texts[b[k]].startswith(f.MARK)]
    assert t.follows(a[fits], b[fits]).tolist() == [t._stays_apart(int(a[k]), int(b[k])) for k in fits]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(f, "CACHE", 3)
    monkeypatch.setattr(f, "TOGETHER", 10)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["one two three four", "four five one", "six seven one two", "", "x" * 60] * 3
    assert ids_of(f.compiled(PATH), texts) == [library.encode(x) for x in texts]


def test_query(spark, tiny):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()] + [(None, "x y"), (7_000, None), (7_000, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, ids string, round_trip int")
    got = f.encoded(df, PATH)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((str(d), library.encode(t or "")) for d, t in rows)
    assert all(r.round_trip for r in got.collect())
    assert sorted((str(r.doc_id), r.text) for r in f.decoded(got, PATH).collect()) == sorted((str(d), (t or "").replace(f.MARK, " ")) for d, t in rows)
    assert f.encoded(df.limit(0), PATH).count() == 0
