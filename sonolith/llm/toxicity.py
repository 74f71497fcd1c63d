"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of hashed embeddings, of the whole word and of its first four and six letters.
Filters of several widths run over the whole sequence of words; the largest response of
each filter over the text goes to a logistic output. Training is mini-batch Adam on the
driver over a bounded sample of labelled rows (``max_rows``, of texts of ``max_bytes`` each at
most, half of them of either label at most, by hash of the id; of texts with one id the least); the fitted arrays have a fixed size, whatever the
input, and go to the workers. A third of the labelled rows is kept from training: all of
them are scored where they are, and counts by language, label and margin (to 1/BINS) set
the output's scale (so that a score is a probability) and, for each language, the threshold.

Defined results: a null text is an empty one and gets the score of no words; a null id is
kept and scored; a language without calibration rows, or not among the LANGUAGES with most of them, uses the threshold of all; with no
labelled rows, or of one label only, every score is 0; labelled texts of over ``max_bytes`` are left out after the rows are chosen, so that the sample is smaller by them; repeated rows are scored each; an
empty table gives an empty result; other columns are ignored, whatever their names. Texts
are scored whole, however long. Language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_of

_WORD = re.compile(r"\w+").findall
#: Rows of each embedding table; its last row is the padding between texts and stays zero.
BUCKETS = 1 << 15
#: Words kept by a worker's cache of hashes.
CACHE = 300_000
#: The sequence is cut into stretches of this many words while scoring, with overlaps as wide as the widest filter.
STRETCH = 20_000
#: Margins are counted in steps of 1/BINS, from -LARGEST to LARGEST, to calibrate with.
BINS, LARGEST = 256, 20
#: Languages with thresholds of their own.
LANGUAGES = 64


@dataclass
class Model:
    whole: np.ndarray
    stem: np.ndarray
    filters: list  # of (width, dim, n)
    offsets: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.7
    constant: bool = False


class _Hashes(dict):
    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) > CACHE:
            self.clear()
        row = lambda mark, part: zlib.crc32(mark + part.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        self[word] = out = (row(b"", word), row(b"4", word[:4]), row(b"6", word[:6]))
        return out


def hashed(text: str, known: _Hashes) -> np.ndarray:
    """(words, 3): a row of the table of words and two of the table of stems."""
    words = _WORD(text.lower())
    return np.array([known[w] for w in words], np.int32).reshape(len(words), 3)


def embedded(model: Model, ids: np.ndarray) -> np.ndarray:
    return model.whole[ids[:, 0]] + model.stem[ids[:, 1]] + model.stem[ids[:, 2]]


def responses(model: Model, ids: np.ndarray) -> np.ndarray:
    """The largest response of each filter over one text; texts shorter than a filter are padded at the end."""
    widest = max(f.shape[0] for f in model.filters)
    ids = np.concatenate([ids, np.full((widest - 1 if len(ids) else widest, 3), BUCKETS - 1, np.int32)])
    best = np.full(len(model.offsets), -np.inf, np.float32)
    for at in range(0, len(ids) - widest + 1, STRETCH):
        part = ids[at : at + STRETCH + widest - 1]
        x = embedded(model, part)
        n, k = len(part) - widest + 1, 0
        for f in model.filters:
            y = x[:n] @ f[0]
            for j in range(1, f.shape[0]):
                y += x[j : j + n] @ f[j]
            best[k : k + f.shape[2]] = np.maximum(best[k : k + f.shape[2]], y.max(axis=0))
            k += f.shape[2]
    return np.maximum(best + model.offsets, 0)


def margin(model: Model, ids: np.ndarray) -> float:
    return float(responses(model, ids) @ model.out + model.bias)


def score_of(model: Model, margins) -> np.ndarray:
    if model.constant:
        return np.zeros(len(margins))
    return np.round(1 / (1 + np.exp(-np.clip(model.scale * np.asarray(margins, float) + model.shift, -30, 30))), 6)


def train(texts: list[str], labels: list[int], dim: int = 12, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, epochs: int = 4, steps: int = 900, batch: int = 16, rate: float = 0.01, least: int = 3, seed: int = 7) -> Model:
    """Mini-batch Adam on the logistic loss, for ``epochs`` and at least ``steps`` batches; the gradient of a maximum goes to the place that gave it."""
    rng = np.random.default_rng(seed)
    model = Model(*((rng.normal(0, 0.1, (BUCKETS, dim))).astype(np.float32) for _ in range(2)), [(rng.normal(0, 0.3, (w, dim, filters))).astype(np.float32) for w in widths], np.zeros(filters * len(widths), np.float32), rng.normal(0, 0.1, filters * len(widths)).astype(np.float32), 0.0)
    model.whole[-1] = model.stem[-1] = 0
    if len(set(labels)) < 2:
        model.constant = True
        return model
    known, widest = _Hashes(), max(widths)
    pad = np.full((widest, 3), BUCKETS - 1, np.int32)
    docs = [np.concatenate([hashed(t, known), pad]) for t in texts]
    # words and stems of fewer than ``least`` training texts stay zero: they would only be learnt by heart
    rare = []
    for p, columns in ((model.whole, slice(0, 1)), (model.stem, slice(1, 3))):
        seen = np.zeros(BUCKETS, np.int32)
        for ids in docs:
            seen[np.unique(ids[:, columns])] += 1
        seen[-1] = 0
        rare.append(seen < least)
        p[rare[-1]] = 0
    y = np.array(labels, np.float32)
    dense = [*model.filters, model.offsets, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (*dense, model.whole, model.stem)]
    bias_moments, step = [0.0, 0.0], 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(max(epochs, -(-steps * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            step += 1
            grads = [np.zeros_like(p) for p in dense]
            rows: list[list] = [[], []]
            values: list = []
            bias_grad = 0.0
            for d in order[at : at + batch]:
                ids = docs[d]
                x = embedded(model, ids)
                n = len(ids) - widest + 1
                tops, places = [], []
                for f in model.filters:
                    r = x[:n] @ f[0]
                    for j in range(1, f.shape[0]):
                        r += x[j : j + n] @ f[j]
                    p = r.argmax(axis=0)
                    places.append(p)
                    tops.append(r[p, np.arange(f.shape[2])])
                a = np.concatenate(tops) + model.offsets
                h = np.maximum(a, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30))) - y[d]) * weight[d]
                bias_grad += g
                grads[-1] += g * h
                da = g * model.out * (a > 0)
                grads[-2] += da
                k = 0
                for f, p, gf in zip(model.filters, places, grads, strict=False):
                    df = da[k : k + f.shape[2]]
                    k += f.shape[2]
                    for j in range(f.shape[0]):
                        gf[j] += x[p + j].T * df
                        rows[0].append(ids[p + j, 0])
                        rows[1].append(ids[p + j, 1:])
                        values.append((f[j] * df).T)
            fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)

            def adam(p, g, m, v, fix=fix):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= fix * m / (np.sqrt(v) + 1e-8)

            for p, g, (m, v) in zip(dense, grads, moments, strict=False):
                adam(p, g / batch, m, v)
            bias_moments[0] = 0.9 * bias_moments[0] + 0.1 * bias_grad / batch
            bias_moments[1] = 0.999 * bias_moments[1] + 0.001 * (bias_grad / batch) ** 2
            model.bias -= fix * bias_moments[0] / (np.sqrt(bias_moments[1]) + 1e-8)
            stacked = np.concatenate(values) / batch
            for p, r, unused, (m, v) in zip((model.whole, model.stem), rows, rare, moments[len(dense) :], strict=True):
                hit = np.concatenate(r).reshape(len(stacked), -1)
                used, where = np.unique(hit, return_inverse=True)
                g = np.zeros((len(used), p.shape[1]), np.float32)
                for column in where.reshape(hit.shape).T:
                    np.add.at(g, column, stacked)
                mm, vv, pp = m[used], v[used], p[used]
                adam(pp, g, mm, vv)
                m[used], v[used], p[used] = mm, vv, pp
                p[used[unused[used]]] = 0
    return model


def calibrate(model: Model, margins: np.ndarray, labels: np.ndarray, langs: list[str], precision: float = 0.97, counts: np.ndarray | None = None) -> None:
    """Scale and shift by logistic regression of the label on the margin; by language the least threshold of that precision.

    counts: how many rows each stands for.
    """
    c = np.ones(len(margins)) if counts is None else np.asarray(counts, float)
    if model.constant or len(set(labels.tolist())) < 2:
        return
    a, b = 1.0, 0.0
    m = np.clip(margins, -LARGEST, LARGEST)
    for _ in range(200):  # with a little ridge, so that separable rows leave a finite scale
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        ga, gb = (c * (p - labels) * m).sum() + 0.1 * (a - 1), (c * (p - labels)).sum() + 0.01 * b
        w = c * (p * (1 - p) + 1e-6)
        haa, hab, hbb = (w * m * m).sum() + 0.1, (w * m).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -0.5, 0.5), b - np.clip(db, -0.5, 0.5)
    model.scale, model.shift = max(a, 0.05), b
    scores = score_of(model, margins)

    def least(chosen: np.ndarray) -> float | None:
        if not labels[chosen].any():
            return None
        for t in np.arange(0.5, 1.0, 0.01):
            hit = chosen & (scores >= t)
            if hit.any() and np.average(labels[hit], weights=c[hit]) >= precision:
                return float(round(t, 2))
        return 0.99

    names = np.array([x or "" for x in langs])
    model.threshold = least(np.ones(len(names), bool)) or 0.7
    model.thresholds = {x: t for x in sorted(set(names.tolist())) if (t := least(names == x)) is not None}


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 2 calibrates, 0 trains."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3))


def _margins(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            bins = np.rint(np.clip([margin(model, hashed(t.as_py(), known)) for t in batch.column(2)], -LARGEST, LARGEST) * BINS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins.astype(np.int32))], names=["doc_id", "lang", "bin"])

    return of


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 64 << 10) -> Model:
    """From at most ``max_rows`` labelled rows to train on, of texts of at most ``max_bytes`` each; calibrated with all labelled rows of another part. None of them is held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    each = [marked.where((fold() == 0) & (F.col("toxic") == label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for label in (0, 1)]
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = texts.select("doc_id", "text").join(F.broadcast(each[0].unionByName(each[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    training = chosen.where(F.octet_length("text") <= max_bytes).orderBy("doc_id").collect()  # max_rows at most, of max_bytes each
    model = train([r.text for r in training], [r.toxic for r in training])
    if not model.constant:
        scored = texts.where(fold() == 2).select("doc_id", "lang", "text").mapInArrow(_margins(model), "doc_id long, lang string, bin int")
        one = scored.groupBy("doc_id").agg(F.min(F.struct("bin", "lang")).alias("x")).join(marked.where(fold() == 2), "doc_id")
        often = texts.where(fold() == 2).select("doc_id", "lang").join(marked, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n")).where("lang is not null").orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
        lang = F.when(F.col("x.lang").isin([r.lang for r in often]), F.col("x.lang")) if often else F.lit(None).cast("string")
        rest = one.groupBy(lang.alias("lang"), "toxic", "x.bin").agg(F.count("*").alias("n")).orderBy("lang", "toxic", "bin").collect()  # bounded by the steps, for LANGUAGES + 1 languages
        if rest:
            calibrate(model, np.array([r.bin for r in rest]) / BINS, np.array([r.toxic for r in rest]), [r.lang for r in rest], counts=np.array([r.n for r in rest]))
    return model


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            scores = score_of(model, [margin(model, hashed(t.as_py(), known)) for t in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return score


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, score, toxic: whether the score reaches the threshold of the document's language."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    scored = texts.mapInArrow(_scores(model), "doc_id long, lang string, score double")
    limit = F.lit(model.threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == lang, value).otherwise(limit)
    return scored.withColumn("toxic", F.col("score") >= limit)


def _rejects(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text")
            scores = score_of(model, [margin(model, hashed(t.as_py() or "", known)) for t in texts])
            limit = np.array([model.thresholds.get(x or "", model.threshold) for x in langs])
            yield batch.filter(pa.array(scores < limit))

    return keep


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of documents (text, lang and any other columns) that the classifier doesn't reject; texts pass once, without a join."""
    return docs.mapInArrow(_rejects(model), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic")
