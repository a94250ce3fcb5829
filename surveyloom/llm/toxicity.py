"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's probability is logistic in its hashed words and word beginnings, and the
bag's is their noisy-or. Weights are learned from document labels alone (on a bounded sample, see SAMPLE), so they say
which sentences offend. Every text is scored whole, in numpy over Arrow batches; labels, lang, source and the id are
never inputs of a score.

Edge cases: null and empty texts have no sentence and score 0; each input row gives one output row (repeated rows and
null ids too); null labels are left out, an id with several labels counts as its largest; without rows of both labels
all scores are 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, least_by_hash, materialise, table
from .words import U, blocks, mix, seeds, word_names, word_spans

#: Labelled rows of each class that a model is fitted on, at most (the first by a hash of the id).
SAMPLE = 1500
FEATURES = 1 << 18
#: Features that a model keeps: those whose document counts differ most between the classes.
KEPT = 4096
PREFIX = 4
THRESHOLD = 0.7
SPLIT = np.ones(256, bool)
SPLIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
ENDS = np.zeros(256, np.int64)
ENDS[[ord(c) for c in ".!?\n"]] = 1


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: rows, and for each occurrence of a feature its row, its sentence (in the block) and its index."""
    for _, n, data, offsets in blocks(column):
        start, end, pointer = word_spans(data, offsets, SPLIT)
        row = np.repeat(np.arange(n), np.diff(pointer))
        sentence = (np.cumsum(ENDS[data])[start] if len(start) else start) + row
        whole = word_names(data, start, end)
        long = np.flatnonzero(end - start > PREFIX)
        begin = mix(word_names(data, start[long], start[long] + PREFIX) + seeds(1, 21)[0])
        index = (np.concatenate([whole, begin]) % U(FEATURES)).astype(np.int64)
        yield n, np.concatenate([row, row[long]]), np.concatenate([sentence, sentence[long]]), index


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature, of a task's rows; feature -1 counts the documents."""
    counts = np.zeros((2, FEATURES), np.int64)
    n_docs = np.zeros(2, np.int64)
    for batch in batches:
        label, at = batch.column(0).to_numpy().astype(np.int64), 0
        for n, row, _, index in _features(batch.column(1)):
            once = np.unique(row * FEATURES + index)
            np.add.at(counts, (label[at + once // FEATURES], once % FEATURES), 1)
            at += n
        n_docs += np.bincount(label, minlength=2)
    y, seen = np.nonzero(counts)
    columns = [np.concatenate([[0, 1], y]), np.concatenate([[-1, -1], seen]), np.concatenate([n_docs, counts[y, seen]])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["label", "feature", "n"])


def _bags(chosen: np.ndarray):
    """label, sentences, and (sentence, place in `chosen`, times) of the features kept, as 32-bit integers one after the other."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(FEATURES, -1)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            sizes, parts = [], []
            for n, row, sentence, index in _features(batch.column(1)):
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(n + 1))
                for a, b in zip(cut[:-1], cut[1:]):
                    own = order[a:b]
                    number = sentence[own] - (sentence[own].min() if b > a else 0)
                    sizes.append(int(number.max()) + 1 if b > a else 1)
                    kept = place[index[own]] >= 0
                    pairs, times = np.unique(number[kept] * len(chosen) + place[index[own][kept]], return_counts=True)
                    parts.append(np.stack([pairs // len(chosen), pairs % len(chosen), times]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], names=["label", "sentences", "parts"])

    return bags


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def most_telling(seen: np.ndarray, n_docs: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Features whose shares of documents differ most between the classes; seen: documents by class and feature."""
    share = (seen + 0.5) / (n_docs[:, None] + 1)
    spread = (share[1] - share[0]) / np.sqrt(share.sum(axis=0) / n_docs.sum() * 2)
    return np.argsort(-np.abs(spread), kind="stable")[:kept]


def fit_noisy_or(bags: list[tuple[int, int, np.ndarray]], kept: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of `kept` features and the bias, by Adam on the noisy-or's log loss (classes weighted equally).

    bags: label, sentences, and an array of sentences, features and times.
    """
    label = np.array([b[0] for b in bags], float)
    sizes = np.array([b[1] for b in bags])
    first, last = np.append(0, np.cumsum(sizes)[:-1]), int(sizes.sum())
    sentence = np.concatenate([b[2][0] + at for b, at in zip(bags, first)])
    feature, times = (np.concatenate([b[2][k] for b in bags]) for k in (1, 2))
    owner = np.repeat(np.arange(len(bags)), sizes)
    weight = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean()) / len(bags)
    theta, bias = np.zeros(kept), -4.0
    m, v = np.zeros(kept + 1), np.zeros(kept + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, theta[feature] * times, last) + bias
        total = np.bincount(owner, _soft(z), len(bags)) + 1e-12
        slope = weight * np.where(label == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        dz = slope[owner] / (1 + np.exp(-z))
        g = np.append(np.bincount(feature, dz[sentence] * times, kept) + 1e-5 * theta, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        theta, bias = theta - step[:-1], bias - step[-1]
    return theta.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from at most `sample` labelled rows of each class; labels: doc_id, toxic.

    Features are counted and chosen before any bag leaves its task; the driver gets counts by feature and, of each sampled document, the
    chosen features by sentence. Of rows that share an id the least text is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    chosen = None
    for y in (0, 1):
        own = least_by_hash(known.where(F.col("toxic") == y), ["doc_id"], counts.get(y, 0), sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    texts = materialise(joined.groupBy("doc_id").agg(F.first("toxic").cast("long").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))
    held = texts.mapInArrow(_held, "label long, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    label, feature, n = (held.column(c).to_numpy() for c in ("label", "feature", "n"))
    n_docs = np.array([n[(feature < 0) & (label == y)].sum() for y in (0, 1)])
    weights = np.zeros(FEATURES, np.float32)
    if not n_docs.all():
        return weights, -40.0
    seen = np.zeros((2, FEATURES))
    seen[label[feature >= 0], feature[feature >= 0]] = n[feature >= 0]
    telling = most_telling(seen, n_docs)
    rows = texts.mapInArrow(_bags(telling), "label long, sentences long, parts binary").toArrow()
    bags = sorted(zip(rows.column("label").to_pylist(), rows.column("sentences").to_pylist(), rows.column("parts").to_pylist()))
    theta, bias = fit_noisy_or([(y, k, np.frombuffer(raw, "<i4").reshape(3, -1).astype(np.int64)) for y, k, raw in bags], len(telling))
    weights[telling] = theta
    return weights, bias


def _scores(weights: np.ndarray, bias: float):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, worst = [], []
            for n, row, sentence, index in _features(batch.column(1)):
                if not len(row):
                    out.append(np.zeros(n))
                    worst += [-1] * n
                    continue
                z = np.bincount(sentence, weights[index]) + bias
                owner = np.zeros(len(z), np.int64)
                owner[sentence] = row
                real = np.bincount(sentence, minlength=len(z)) > 0
                total = np.bincount(owner[real], _soft(z[real]), n)
                out.append(-np.expm1(-total))
                first = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(first, row, sentence)
                best = np.full(n, -1)
                order = np.flatnonzero(real)[np.argsort(z[real], kind="stable")]
                best[owner[order]] = order - first[owner[order]]
                worst += best.tolist()
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(worst, pa.int64())], names=["doc_id", "score", "worst_sentence"])

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score, worst_sentence (its number in the text among stretches up to . ! ? or a line's end; -1: none)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scores(*model), "doc_id long, score double, worst_sentence long")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 3 == 1
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence")


QUERIES = {"op9_toxicity": op9_toxicity}
