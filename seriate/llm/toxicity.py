"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model over its distinct words,
and the document's is their noisy-or: one minus the product of the sentences' complements. The model is trained
from document labels alone, through the noisy-or, and afterwards points at the sentences that gave offence.

Learning takes at most DOCS_PER_LABEL labelled documents of each class (the least hash in each of as many hash
buckets). Their words are counted and their sentences are reduced to the model's words in parallel; equal
sentences of a document count as one with a weight, and only those numbers reach the one task that fits the weights.
Scoring reads whole texts.

Defined results: a null or empty text, or one without words, has score 0; without labels of both classes there is no
model and every score is 0; of several labels of a doc_id the highest counts; of several texts of a learned doc_id
the one with the least hash does; a null doc_id is never used to learn and counts as held out if the checksum of the
empty string says so; a sentence of more than LONGEST words counts as several, and `offending` numbers them so;
repeated rows stay; only doc_id and text are read, and doc_id and toxic of the labels.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import arrow_map, bytes_of, stored, with_hint
from seriate.llm.langid import fold

DOCS_PER_LABEL = 4096
#: Words of the model: at most VOCABULARY of those in MIN_DOCS documents of the sample or more that lie CLEAR standard
#: deviations further among offensive documents than chance would put them.
VOCABULARY, MIN_DOCS, CLEAR = 5_000, 3, 3.5
STEPS, RATE, SHRINK = 600, 0.1, 1e-5
#: Words of a sentence without an end; a longer one is cut.
LONGEST = 200
_SENTENCE = re.compile(rb"[.!?\n]+")
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_RESULT = "doc_id long, held_out boolean, score double, predicted int, offending array<int>"


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence that has any."""
    out = []
    for s in _SENTENCE.split(text.lower()):
        words = _WORD.findall(s)
        out += [words[i : i + LONGEST] for i in range(0, len(words), LONGEST)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word, and those of them with label 1, for each task."""
    seen: dict[bytes, list[int]] = {}
    for b in batches:
        for text, label in zip(bytes_of(b["text"]), b["toxic"].to_pylist(), strict=True):
            for w in set(_WORD.findall(text.lower())):
                n = seen.setdefault(w, [0, 0])
                n[0] += 1
                n[1] += label == 1
        if len(seen) > 500_000:
            yield _word_rows(seen)
            seen = {}
    yield _word_rows(seen)


def _word_rows(seen: dict[bytes, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([n[i] for n in seen.values()], pa.int64()) for i in (0, 1))], ["word", "total", "bad"])


def _bags(words: dict[bytes, int]):
    """Each document as its distinct sentences over the model's words, as often as each comes; the empty one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [json.dumps([[list(k), n] for k, n in sorted(bag(t, words).items())]) for t in bytes_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(bags, pa.string())], ["doc_id", "toxic", "bag"])

    return run


def bag(text: bytes, words: dict[bytes, int]) -> Counter:
    return Counter(tuple(sorted({words[w] for w in s if w in words})) for s in sentences(text))


def trained(bags: list[list], labels: list[int], words: int, prior: float) -> tuple[float, np.ndarray] | None:
    """Bias and weights of the words, by Adam on the likelihood of the noisy-or; small weights shrink to zero.

    bags: of each document, pairs of a sentence's words and how often it comes. prior: share of label 1 among all
    labelled documents, of which the sample may hold another share. None without both labels.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    doc_of, times, rows, cols = [], [], [], []
    for d, sentences_ in enumerate(bags):
        for known, n in sentences_:
            rows += [len(doc_of)] * len(known)
            cols += known
            doc_of.append(d)
            times.append(n)
    doc_of, times, rows, cols = (np.array(x, int) for x in (doc_of, times, rows, cols))
    some = np.bincount(doc_of, minlength=len(y)) > 0
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * some
    theta = np.zeros(words + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(rows, theta[cols], len(doc_of))
        total = np.bincount(doc_of, times * np.logaddexp(0, z), len(y))  # minus the log of the product of complements
        slope = weight * np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        dz = slope[doc_of] * times / (1 + np.exp(-z))
        g = np.append(np.bincount(cols, dz[rows], words), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta -= step * m / (1 - 0.9**t)
        w = theta[:-1]
        theta[:-1] = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(step[:-1], 10.0) * SHRINK)
    return float(theta[-1]), theta[:-1]


def _train(words: int, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, labels = [], []
        for b in batches:
            bags += map(json.loads, b["bag"].to_pylist())
            labels += b["toxic"].to_pylist()
        model = trained(bags, labels, words, prior)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model and [model[0], model[1].tolist()])])], ["model"])

    return run


def learned(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[bytes, float]] | None:
    """Bias and the words' weights, or None where the labels don't have both classes."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.least(F.max(F.col("toxic").cast("int")), F.lit(1)).alias("toxic"))
    prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    h = F.xxhash64("doc_id")
    picked = rows.groupBy("toxic", F.pmod(h, F.lit(DOCS_PER_LABEL)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x")).select(F.col("x.doc_id").alias("doc_id"), "toxic")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(with_hint(stored(picked, "toxicity-ids"), 2 * DOCS_PER_LABEL), "doc_id")
    sample = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "toxic", "x.text")
    sample = stored(sample.repartition("doc_id"), "toxicity-sample")
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < share < 1:
        return None
    seen = arrow_map(sample, _counted, "word binary, total long, bad long").groupBy("word").agg(F.sum("total").alias("total"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.lit(share) * F.col("total")) / F.sqrt(F.lit(share * (1 - share)) * F.col("total"))
    clear = seen.where(F.col("total") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= CLEAR).orderBy(F.col("z").desc(), "word").limit(VOCABULARY)
    words = {bytes(r["word"]): i for i, r in enumerate(clear.collect())}
    bags = arrow_map(sample, _bags(words), "doc_id long, toxic int, bag string").orderBy("doc_id").coalesce(1)
    bias, weights = json.loads(arrow_map(bags, _train(len(words), prior), "model string").first()["model"])
    return bias, {w: weights[i] for w, i in words.items() if weights[i]}


def scored(text: bytes, model: tuple[float, dict[bytes, float]] | None) -> tuple[float, list[int]]:
    """The document's probability, and the numbers of the sentences that are more likely offensive than not."""
    if model is None:
        return 0.0, []
    (bias, weights), total, offending = model, 0.0, []
    base = np.log1p(np.exp(bias))
    plain = 0
    for i, s in enumerate(sentences(text)):
        known = {w for w in s if w in weights}
        if not known:
            plain += 1
            continue
        z = bias + sum(weights[w] for w in known)
        total += np.logaddexp(0, z)
        if z >= 0:
            offending.append(i)
    return float(-np.expm1(-(total + plain * base))), offending


def _score(model: tuple[float, dict[bytes, float]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scored(t, model) for t in bytes_of(b["text"])]
            score = np.array([x[0] for x in got], float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([x[1] for x in got], pa.list_(pa.int32()))], [c.split()[0] for c in _RESULT.split(", ")])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (numbers of sentences) of every row."""
    model = learned(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _score(model), _RESULT)
