"""Language ID: a linear-chain conditional random field that labels every word of a text with a language.

A word's features are hashed affixes, n-grams of letters (with its ends marked) and itself, and
what a lexicon says of it: how large a share of its uses each language has. Transitions between
languages are learnt, on sequences that change language as code-switched text does. They are
made of spans of training documents. Forward-backward gives every word's chances of each
language; a document's language is the one with the largest sum.

Training is Adam on the driver over a bounded sample: of at most ``max_langs`` languages (the most frequent with ``least``
learnable documents) ``per_lang`` documents each, by hash of the id, and of each of these ``sample_words`` words in spans from all over
the text. Half of the documents make the lexicon, the others train, so that its features are
not trusted more than they hold on other texts. The fitted arrays have a bounded size and go to the workers.

Inference runs in tasks over batches: forward-backward over the concatenated words of many documents in lanes
of equal length, each lane's transfer matrix first, so its cost is the same for short and long texts.
Texts of over PIECE characters are labelled in pieces, cut between words.

Defined results: a null text and a text without a letter are ``und`` with score 0, and so is every text if nothing can be learnt; an
empty string is a language like others, null is none; with one language all texts with letters have it, with score 1; null ids
are kept and labelled, but not learnt from; of rows of one id and language one is learnt from; repeated rows are labelled each; ties go to the smaller name;
an empty table gives an empty result; other columns are ignored, whatever their names. Texts are labelled whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of letters; where there are any, with the marks that combine with them.
_WORD, _MARKED, _MARK = re.compile(r"[^\W\d_]+"), re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+"), re.compile(r"[\u0300-\u036f]").search
_LETTERS_ONLY = {c: " " for c in range(128) if not chr(c).isalpha()}
_BREAK = re.compile(r"[^\w\u0300-\u036f]|[\d_]").search
#: Rows of the table of hashed features; the lexicon's own rows follow.
BUCKETS = 1 << 16
#: Characters of a piece of a long text, and words that are labelled at once.
PIECE, AT_ONCE = 1_000_000, 300_000
#: Words of a lane, and steps until chances are scaled again.
LANE, RESCALE = 128, 4
#: Words whose scores a worker keeps.
REMEMBERED = 300_000
#: Words of the lexicon; the least uses and shares that count; steps of the share.
LEXICON, USES, SHARES = 20_000, 3, (0.1, 0.5, 0.9)
#: Words of a training sequence and of a span of the sample.
SEQUENCE, SPAN = 24, 32
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    transitions: np.ndarray | None = None
    first: np.ndarray | None = None
    lexicon: dict = field(default_factory=dict)  # word: rows of the table


def features(words: list[str], lexicon: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) pairs: the rows of the table that each word has."""
    marked = [f"^{w.lower()}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    own = np.repeat(np.arange(len(words)), sizes)
    left = np.arange(len(codes)) - begins[own]  # places before a character in its word
    right = sizes[own] - left  # and from it on
    prime, mixed = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    row = lambda h, salt: ((((h ^ np.uint64(salt)) * mixed) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
    of, rows = [], []
    grams = codes
    for n in (2, 3, 4):
        grams = grams[:-1] * prime + codes[n - 1 :]
        here = np.flatnonzero(right[: len(grams)] >= n)
        at = own[here]
        if n < 4:  # n-grams anywhere
            of.append(at)
            rows.append(row(grams[here], n))
        # affixes with the end's mark: what begins and what ends a word
        for salt, edge in ((10 + n, left[here] == 0), (20 + n, right[here] == n)):
            of.append(at[edge])
            rows.append(row(grams[here[edge]], salt))
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), prime))
    if len(words):
        of.append(np.arange(len(words)))
        rows.append(row(np.add.reduceat(codes * powers[left], begins), 30))
    known = [(k, r) for k, m in enumerate(marked) for r in lexicon.get(m[1:-1], ())]
    if known:
        pairs = np.array(known, np.int64)
        of.append(pairs[:, 0])
        rows.append(pairs[:, 1])
    return np.concatenate(of), np.concatenate(rows)


def emissions(words: list[str], model: Model) -> np.ndarray:
    """(words, labels): the mean weight of a word's features, times the root of their number."""
    of, rows = features(words, model.lexicon)
    n = np.maximum(np.bincount(of, minlength=len(words)), 1)
    total = np.stack([np.bincount(of, model.weights[rows, k], len(words)) for k in range(len(model.labels))], axis=1)
    return total / np.sqrt(n)[:, None]


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def _forward(e: np.ndarray, heads: np.ndarray, a: np.ndarray, s: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Chances given the words so far, up to a factor: (lanes, steps, labels). heads: where a sequence begins."""
    out = np.empty_like(e)
    for t in range(e.shape[1]):
        new = state @ a
        at = np.flatnonzero(heads[:, t])
        new[at] = state[at].sum(axis=1, keepdims=True) * s
        new *= e[:, t]
        state = out[:, t] = new if t % RESCALE else _scaled(new, 1)
    return out


def _backward(e: np.ndarray, heads: np.ndarray, a: np.ndarray, s: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.empty_like(e)
    for t in range(e.shape[1] - 1, -1, -1):
        out[:, t] = state
        ahead = e[:, t] * state
        state = ahead @ a.T
        at = np.flatnonzero(heads[:, t])
        state[at] = (ahead[at] @ s)[:, None]
        state = state if t % RESCALE else _scaled(state, 1)
    return out


def _transfer(e: np.ndarray, heads: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What a lane as a whole does to a state, up to a factor: (lanes, labels, labels)."""
    lanes, steps, k = e.shape
    m = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for t in range(steps):
        moved = (m.reshape(-1, k) @ a).reshape(m.shape)
        at = np.flatnonzero(heads[:, t])
        moved[at] = m[at].sum(axis=2, keepdims=True) * s
        moved *= e[:, t, None, :]
        m = moved if t % RESCALE else _scaled(moved, (1, 2))
    return _scaled(m, (1, 2))


def posteriors(scores: np.ndarray, heads: np.ndarray, transitions: np.ndarray, first: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Forward-backward over sequences that stand one after the other: (words, labels), rows add up to 1."""
    n, k = scores.shape
    lane = max(1, min(lane, n))
    lanes = -(-n // lane)
    e = np.ones((lanes * lane, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    marks = np.ones(lanes * lane, bool)
    marks[:n] = heads
    e, marks = e.reshape(lanes, lane, k), marks.reshape(lanes, lane)
    a, s = np.exp(transitions), np.exp(first)
    m = _transfer(e, marks, a, s)
    before, after = np.empty((lanes, k)), np.empty((lanes, k))
    state = np.full(k, 1 / k)
    for p in range(lanes):
        before[p] = state
        state = state @ m[p]
        state /= max(state.sum(), 1e-300)
    state = np.full(k, 1 / k)
    for p in range(lanes - 1, -1, -1):
        after[p] = state
        state = m[p] @ state
        state /= max(state.sum(), 1e-300)
    both = _forward(e, marks, a, s, before) * _backward(e, marks, a, s, after)
    return _scaled(both.reshape(-1, k)[:n], 1)


def train(sample: list[tuple[str, list[str]]], labels: list[str], steps: int = 240, batch: int = 192, rate: float = 0.05, ridge: float = 1e-6, seed: int = 11) -> Model:
    """From (label, words) of documents, those at even places for the lexicon and the others to train on (all, if they are few)."""
    model = Model(sorted(labels))
    k = len(model.labels)
    if not k:
        return model
    place = {x: i for i, x in enumerate(model.labels)}
    counted: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for label, words in sample[::2]:
        for w, c in Counter(w.lower() for w in words).items():
            counted[w][place[label]] += c
    often = sorted(((w, c) for w, c in counted.items() if c.sum() >= USES), key=lambda x: (-x[1].sum(), x[0]))[:LEXICON]
    for w, c in often:
        share = c / c.sum()
        model.lexicon[w] = tuple(BUCKETS + 3 * i + sum(share[i] >= x for x in SHARES) - 1 for i in range(k) if share[i] >= SHARES[0])
    model.weights = np.zeros((BUCKETS + 3 * k, k))
    model.transitions, model.first = np.zeros((k, k)), np.zeros(k)
    by_label: list[list[list[str]]] = [[] for _ in range(k)]
    for label, words in sample[1::2] if len(sample) >= 4 * k else sample:
        if words:
            by_label[place[label]].append(words)
    there = [i for i in range(k) if by_label[i]]
    if k == 1 or not there:
        return model
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for words in by_label[i]] for i in range(k)]
    of, rows = features(list(vocabulary), model.lexicon)
    order = np.argsort(of, kind="stable")
    rows = rows[order]
    ends = np.cumsum(np.bincount(of, minlength=len(vocabulary)))
    begins = np.concatenate([[0], ends[:-1]])
    root = np.sqrt(np.maximum(ends - begins, 1))
    heads = np.zeros((batch, SEQUENCE), bool)
    heads[:, 0] = True
    params = [model.weights, model.transitions, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        ids, gold = np.empty((batch, SEQUENCE), np.int64), np.empty((batch, SEQUENCE), np.int64)
        for b in range(batch):
            at = 0
            while at < SEQUENCE:  # a sequence of one language or of spans of several
                i = there[rng.integers(len(there))]
                words = coded[i][rng.integers(len(coded[i]))]
                size = min(SEQUENCE - at, len(words), SEQUENCE if at == 0 and rng.random() < 0.5 else int(rng.integers(3, 13)))
                start = rng.integers(len(words) - size + 1)
                ids[b, at : at + size], gold[b, at : at + size] = words[start : start + size], i
                at += size
        used, where = np.unique(ids, return_inverse=True)
        where = where.reshape(ids.shape)
        counts = ends[used] - begins[used]
        shift = np.concatenate([[0], np.cumsum(counts)[:-1]])
        pick = rows[np.repeat(begins[used] - shift, counts) + np.arange(counts.sum())]
        word = np.repeat(np.arange(len(used)), counts)
        scores = np.stack([np.bincount(word, model.weights[pick, j], len(used)) for j in range(k)], axis=1) / root[used][:, None]
        each = scores[where]
        e = np.exp(each - each.max(axis=2, keepdims=True))
        a, s = np.exp(model.transitions), np.exp(model.first)
        flat = np.full((batch, k), 1 / k)
        alpha, beta = _forward(e, heads, a, s, flat), _backward(e, heads, a, s, flat)
        gamma = _scaled(alpha * beta, 2)
        pairs = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
        pairs = _scaled(pairs, (2, 3)).sum(axis=(0, 1))
        np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        start_grad = gamma[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=k)
        wrong = gamma.reshape(-1, k).copy()
        wrong[np.arange(gold.size), gold.ravel()] -= 1
        by_word = np.stack([np.bincount(where.ravel(), wrong[:, j], len(used)) for j in range(k)], axis=1) / root[used][:, None]
        grad = np.stack([np.bincount(pick, by_word[word, j], len(model.weights)) for j in range(k)], axis=1)
        for p, g, (m, v) in zip(params, (grad, pairs, start_grad), moments, strict=True):
            g = g / batch + ridge * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3))


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            found = _BREAK(text, at + PIECE)
            end = found.end() if found else end
        yield at, text[at:end]
        at = end


def _words(text: str) -> list[str]:
    """Words with a letter; the patterns also take numerals that are neither digits nor letters."""
    if text.isascii():
        return text.translate(_LETTERS_ONLY).split()
    found = (_MARKED if _MARK(text) else _WORD).findall(text)
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _sampled(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                text, places = text.as_py(), max(1, words // SPAN)
                found = []
                width = max(1, len(text) // places)
                for p in range(places):  # a span from each equal part of the text
                    part = _BREAK(text, p * width + zlib.crc32(f"{i}/{p}".encode()) % max(1, width - SPAN * 8)) if p else None
                    start = part.end() if part else p * width
                    found += _words(text[start : max(start, min((p + 1) * width, start + SPAN * 16))])[: SPAN if width < len(text) else words]
                spans.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.string())], names=["doc_id", "lang", "words"])

    return run


def fit(docs: DataFrame, max_langs: int = 32, least: int = 5, per_lang: int = 400, sample_words: int = 320) -> Model:
    """Learnt from documents with an id, a text and a language that are not held out, within the bounds named."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learnable = own.where("doc_id is not null and lang is not null and text is not null").where(fold() != 1)
    counts = {r.lang: r.n for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = list(counts)
    if not langs:
        return Model()
    # of a frequent language only rows whose hash is so low that they can be among the first are ranked, about twice as many as are taken
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    low = reduce(lambda x, lang: x.when(F.col("lang") == lang, F.lit(int(min(1.0, 2 * per_lang / counts[lang]) * (1 << 53)))), langs, F.when(F.lit(False), F.lit(0)))
    ranked = learnable.select("doc_id", "lang").where(place < low).withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id")))
    chosen = ranked.where(F.col("rn") <= per_lang).select("doc_id", "lang").distinct()  # per_lang of max_langs languages at most
    texts = learnable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    spans = texts.mapInArrow(_sampled(sample_words), "doc_id long, lang string, words string")
    one = spans.groupBy("doc_id", "lang").agg(F.min("words").alias("words")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang")
    return train([(r.lang, r.words.split()) for r in one.collect()], langs)


class _Labelled:
    """Words of documents, gathered until they are AT_ONCE, then labelled together. Scores of words are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary: dict = defaultdict()
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.vocabulary.clear()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.scores = np.empty((0, len(self.model.labels)))

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.owners: list[int] = []
        self.held = 0

    def add(self, owner: int, words: list[str]) -> None:
        if words:
            self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
            self.owners.append(owner)
            self.held += len(words)

    def chances(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The sequences' owners and begins, and every word's chances; what was gathered is cleared."""
        sizes = np.array([len(x) for x in self.ids])
        begins = np.cumsum(sizes) - sizes
        heads = np.zeros(self.held, bool)
        heads[begins] = True
        if new := list(islice(self.vocabulary, len(self.scores), None)):
            self.scores = np.concatenate([self.scores, emissions(new, self.model)])
        out = self.owners, begins, posteriors(self.scores[np.concatenate(self.ids)], heads, self.model.transitions, self.model.first)
        self.clear()
        if len(self.vocabulary) > REMEMBERED:
            self.forget()
        return out


def _predicted(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _Labelled(model)
        for batch in batches:
            total = np.zeros((batch.num_rows, max(k, 1)))

            def settle(total=total):
                if some.held:
                    owners, begins, p = some.chances()
                    np.add.at(total, owners, np.add.reduceat(p, begins, axis=0))

            for row, text in enumerate(batch.column(1)):
                if k and text.is_valid:
                    for _, piece in _pieces(text.as_py()):
                        some.add(row, _words(piece))
                        if some.held >= AT_ONCE:
                            settle()
            settle()
            words, best = total.sum(axis=1), np.round(total, 9).argmax(axis=1)
            score = np.where(words > 0, total[np.arange(len(total)), best] / np.maximum(words, 1e-300), 0.0)
            names = np.array([*model.labels, UNKNOWN], object)[np.where(words > 0, best, k)] if k else [UNKNOWN] * len(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(names), pa.string()), pa.array(np.clip(np.round(score, 6), 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the language with the largest share of the words' chances, and that share."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


SPANS = "array<struct<start: int, end: int, lang: string, n_words: int, score: double>>"


def _switched(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("n_words", pa.int32()), ("score", pa.float64())]))

    def spans_of(text: str, some: _Labelled) -> list[dict]:
        out: list[dict] = []
        for at, piece in _pieces(text):
            found = [m for m in (_MARKED if _MARK(piece) else _WORD).finditer(piece) if any(map(str.isalpha, m.group()))]
            if not found:
                continue
            some.add(0, [m.group() for m in found])
            chances = some.chances()[2]
            for m, p in zip(found, chances, strict=True):
                best = int(np.round(p, 9).argmax())
                if not out or out[-1]["lang"] != model.labels[best]:
                    out.append({"start": at + m.start(), "end": 0, "lang": model.labels[best], "n_words": 0, "score": 0.0})
                out[-1]["end"] = at + m.end()
                out[-1]["n_words"] += 1
                out[-1]["score"] += float(p[best])
        return [s | {"score": round(s["score"] / s["n_words"], 6)} for s in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _Labelled(model)
        for batch in batches:
            spans = [spans_of(t.as_py(), some) if t.is_valid and model.labels else [] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def switches(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: stretches of words with one likeliest language, by characters of the text, with the mean chance of their words."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_switched(model), f"doc_id long, spans {SPANS}")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages(docs, fit(docs)).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
