"""Token counts and packing against the library and the packing rules."""

import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sonolith.llm.bpe import Encoder, PreTokenizer
from sonolith.llm.packing import pack, plan
from sonolith.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "It's <|endoftext|> A", "Σας ΣΑΣ İ áb x y\x1cz", "<|startoftext|><|endoftext|>", "日本語 テスト 123", "é É q <| x", "don't I'LL 're ”quoted“ ½ ²", "ǅ ẞ ﬁ Å", "a_b__c", "​x y", "é İ", "1234567", "x" * 3000, "🙂👍🏽 ok", "\x00\x7f", "it'll'd we've", "¹²³ ª º µ", "Ǆ ŉ İI"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    encode = Encoder(PATH)
    for text in HARD:
        assert encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text
    pre = PreTokenizer(PATH)
    assert pre("It's the end") == ["it", "'s", "the", "end"]


def test_counts(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, None), (None, "no id"), (1, "twice"), (1, "twice"), (20_001, "word " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, block int, words string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)
    assert got == want
    assert token_counts(df.limit(0), PATH).count() == 0


def test_packing(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(250).collect()]
    rows += [(20_000, None), (None, "no id"), (1, "twice"), (1, "twice"), (20_001, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, length int, rank string").repartition(3)
    got = pack(df, PATH).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, a, len(ids[a : a + 4096]), zlib.crc32(array("I", ids[a : a + 4096]).tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(filled) <= -(-total // 4096) * 1.05 + 1
    assert pack(df.limit(0), PATH).count() == 0


def test_plan_places_every_item_once():
    histogram = {4096: 5, 3000: 7, 1096: 3, 1000: 40, 7: 1000, 1: 3}
    taken, used = {}, {}
    for length, lo, hi, first, offset in plan(histogram, 4096):
        for k in range(hi - lo):
            assert (length, lo + k) not in taken
            taken[length, lo + k] = first + k
            used.setdefault(first + k, []).append((offset, length))
    assert len(taken) == sum(histogram.values())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_plan_takes_as_many_sequences_as_best_fit_item_by_item():
    import random

    rng = random.Random(9)
    for capacity in (10, 64, 4096):
        lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 8))]) for _ in range(600)]
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [(r, k) for k, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(capacity - n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        used = {first + k for _, lo, hi, first, _ in plan(histogram, capacity) for k in range(hi - lo)}
        assert len(used) == len(room)
