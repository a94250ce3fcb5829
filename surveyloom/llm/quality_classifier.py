"""Quality classifier from weak labels.

Overlapping heuristics vote for, against or abstain; expectation-maximisation over the counts of vote patterns of all
documents (3**labellers patterns at most) estimates how accurate each is and how likely each pattern is junk. The
posteriors are the labels of a linear scorer over hashed word shapes, fitted on a bounded sample (SAMPLE), and the
scorer decides.

Edge cases: null and empty texts have no words: nothing speaks against them and they score 1 (kept); each input row
gives one output row, null ids and repeated rows too; `accepted` keeps all columns of `docs`; an empty table gives an
empty result; where one class is empty, all documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_by_hash, materialise, table, without
from .words import U, blocks, gram_names, word_names, word_spans

#: Documents of each side of the posterior that the scorer is fitted on, at most (the first by a hash of id and votes).
SAMPLE = 4000
FEATURES = 1 << 14
LABELLERS = ("symbols", "tables", "capitals", "repeats", "echoes", "marks", "odd_words", "few_kinds")
ABSTAIN, JUNK, GOOD = 0, 1, 2
#: (junk from, good up to) of each labeller's rate; between them it abstains.
CUTS = {"symbols": (0.20, 0.05), "tables": (0.20, 0.05), "capitals": (0.50, 0.20), "repeats": (0.50, 0.10), "echoes": (0.40, 0.10), "marks": (0.50, 0.25), "odd_words": (0.40, 0.15), "few_kinds": (0.75, 0.60)}
#: Before any vote is seen: abstain, junk and good votes about good and about junk texts, and how many documents of a
#: hundred this belief weighs. Labellers are seldom wrong about good texts; junk is of many kinds, each known to a few.
BELIEF, BELIEF_PERCENT = np.array([[0.10, 0.005, 0.895], [0.05, 0.35, 0.60]]), 5
KIND = np.full(256, ord("."), np.uint8)
KIND[[*range(0x41, 0x5B)]] = ord("A")
KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = ord("a")
KIND[[*range(0x30, 0x3A)]] = ord("0")
for _c in "#*$%&|<>!?@_=+~^":
    KIND[ord(_c)] = ord(_c)


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The name of each word's shape: kinds of characters with runs written once ('Aa', 'A!', 'a*', '|')."""
    kinds = KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[start] = True
    before = np.append(0, np.cumsum(keep))
    return word_names(kinds[keep], before[start], before[end], lower=False)


def _rates(data: np.ndarray, start: np.ndarray, end: np.ndarray, pointer: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Rows by labellers: the measured rates."""
    n, words = len(pointer) - 1, np.diff(pointer)
    row = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)

    def inside(which: np.ndarray) -> np.ndarray:
        ahead = np.append(0, np.cumsum(which))
        return ahead[end] - ahead[start]

    symbol = np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8))
    upper = KIND[data] == ord("A")
    echo = np.zeros(len(names), bool)
    echo[1:] = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
    again = np.zeros(n)
    grams = gram_names(names, 3)
    for i in np.flatnonzero(words > 3).tolist():
        own = np.sort(grams[pointer[i] : pointer[i + 1] - 2])
        again[i] = (own[1:] == own[:-1]).mean()
    wordy = np.isin(KIND[data], np.frombuffer(b"aA", np.uint8)) | np.isin(data, np.frombuffer(b".,;:'\"()-?", np.uint8))
    kinds = np.zeros(n)
    for i in np.flatnonzero(words >= 20).tolist():
        own = np.sort(names[pointer[i] : pointer[i + 1]])
        # Distinct words thin out with length; they are compared with the square root of the word count.
        kinds[i] = 1 - min(1.0, ((own[1:] != own[:-1]).sum() + 1) / (4 * np.sqrt(len(own))))
    letters = np.maximum(np.bincount(row, end - start, n), 1)
    return np.column_stack([
        np.bincount(row, inside(symbol) > 0, n) / some,
        np.bincount(row, inside(data == ord("|")) > 0, n) / some,
        np.bincount(row, inside(upper), n) / letters,
        again,
        np.bincount(row, echo, n) / some,
        np.bincount(row, inside(data == ord("!")) > 0, n) / some,
        np.bincount(row, inside(wordy) < end - start, n) / some,
        kinds,
    ])


def _votes(rates: np.ndarray) -> np.ndarray:
    """One number a row, base 3 over the labellers."""
    code = np.zeros(len(rates), np.int64)
    for j, name in enumerate(LABELLERS):
        junk, good = CUTS[name]
        code += 3**j * np.where(rates[:, j] >= junk, JUNK, np.where(rates[:, j] <= good, GOOD, ABSTAIN))
    return code


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, votes, features, values = [], [], [], []
        for _, n, data, offsets in blocks(batch.column(1), 1 << 18):
            start, end, pointer = word_spans(data, offsets)
            names = word_names(data, start, end)
            words += np.diff(pointer).tolist()
            votes += _votes(_rates(data, start, end, pointer, names)).tolist()
            shape = (_shapes(data, start, end) % U(FEATURES - 1)).astype(np.int64)
            echo = np.zeros(len(names), bool)
            echo[1:] = names[1:] == names[:-1]
            for a, b in zip(pointer[:-1].tolist(), pointer[1:].tolist()):
                own, counts = np.unique(shape[a:b], return_counts=True)
                same = int(echo[a + 1 : b].sum())
                features.append(np.append(own, FEATURES - 1).astype(np.int32))
                values.append((np.append(counts, same) / max(b - a, 1)).astype(np.float32))
        arrays = [pa.array(words, pa.int64()), pa.array(votes, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "votes", "feature", "value"])


def estimate_accuracies(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """P(junk) of each vote pattern, and P(vote | class) as labellers x classes (good, junk) x votes, by EM."""
    codes = sorted(patterns)
    count = np.array([patterns[c] for c in codes], float)
    vote = np.array([[c // 3**j % 3 for j in range(len(LABELLERS))] for c in codes]).reshape(len(codes), len(LABELLERS))
    junk = np.where((vote == JUNK).any(axis=1), 0.9, 0.05)
    table_ = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        share = np.column_stack([(1 - junk) * count, junk * count])
        for j in range(len(LABELLERS)):
            for v in range(3):
                table_[j, :, v] = share[vote[:, j] == v].sum(axis=0) + BELIEF[:, v] * count.sum() * BELIEF_PERCENT / 100
        table_ /= table_.sum(axis=2, keepdims=True)
        prior = (share.sum(axis=0) + 1) / (count.sum() + 2)
        logs = np.log(prior)[None, :] + sum(np.log(table_[j][:, vote[:, j]]).T for j in range(len(LABELLERS)))
        odds = np.clip(logs[:, 1] - logs[:, 0], -50, 50)
        junk = 1 / (1 + np.exp(-odds))
    return dict(zip(codes, junk.tolist())), table_


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights of good (target 1) over hashed features, classes weighted equally."""
    weights = np.zeros(FEATURES)
    if not len(rows) or target.max() < 0.5 or target.min() > 0.5:
        return weights, 40.0
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    feature = np.concatenate([i for i, _ in rows])
    value = np.sqrt(np.concatenate([v for _, v in rows]))
    side = target >= 0.5
    weight = np.where(side, 0.5 / side.mean(), 0.5 / (~side).mean()) / len(rows)
    bias, m, v = 0.0, np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * weights[feature], len(rows)) + bias
        slope = weight * (1 / (1 + np.exp(-z)) - target)
        g = np.append(np.bincount(feature, slope[row] * value, FEATURES) + 1e-5 * weights, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def _scored(weights: np.ndarray, bias: float):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, value = batch.column("feature"), batch.column("value")
            lengths = feature.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            z = np.bincount(row, np.sqrt(value.flatten().to_numpy()) * weights[feature.flatten().to_numpy()], batch.num_rows) + bias
            score = np.where(batch.column("n_words").to_numpy() > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 1.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "print", "n_words", "votes")], pa.array(score)], names=["doc_id", "print", "n_words", "votes", "score"])

    return scored


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for made in _measured(iter([batch])):
            yield pa.RecordBatch.from_arrays([made.column(0), batch.column(2), *made.columns[1:]], names=["doc_id", "print", *made.schema.names[1:]])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, print (hash of the text), n_words, votes, score (1: good), p_junk (the weak label), kept; a row per row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("print"))
    measured = materialise(texts.mapInArrow(_keyed, "doc_id long, print long, n_words long, votes long, feature array<int>, value array<float>"))
    patterns = {r["votes"]: r["n"] for r in measured.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    junk = estimate_accuracies(patterns)[0] if patterns else {}
    weak = spark.createDataFrame(list(junk.items()) or [(-1, 0.0)], "votes long, p_junk double")
    labelled = measured.where("n_words > 0").join(F.broadcast(weak), "votes")  # 3**labellers patterns at most
    rows = []
    for side, is_junk in (("p_junk < 0.5", False), ("p_junk >= 0.5", True)):
        n = sum(patterns[v] for v, p in junk.items() if (p >= 0.5) == is_junk)
        own = least_by_hash(labelled.where(side), ["doc_id", "print", "votes"], n, sample)
        rows += own.select("p_junk", "feature", "value").toArrow().to_pylist()
    model = fit_linear([(np.array(r["feature"]), np.array(r["value"])) for r in rows], np.array([1 - r["p_junk"] for r in rows]))
    scored = measured.mapInArrow(_scored(*model), "doc_id long, print long, n_words long, votes long, score double")
    return scored.join(F.broadcast(weak), "votes", "left").withColumn("kept", F.col("score") >= 0.5)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that the scorer rejects."""
    gone = classify(docs, id_col, text_col).where("not kept").select("doc_id", "print").distinct()
    return without(docs, gone, id_col, text_col)


def accuracies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """labeller, p_junk_when_junk, p_junk_when_good, p_abstain: what expectation-maximisation finds about each labeller."""
    patterns = {r["votes"]: r["n"] for r in classify(docs, id_col, text_col).where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    rows = []
    if patterns:
        junk, tables = estimate_accuracies(patterns)
        share = sum(junk[v] * n for v, n in patterns.items()) / sum(patterns.values())
        rows = [(name, *(float(x) for x in (t[1, JUNK], t[0, JUNK], share * t[1, ABSTAIN] + (1 - share) * t[0, ABSTAIN]))) for name, t in zip(LABELLERS, tables)]
    return docs.sparkSession.createDataFrame(rows, "labeller string, p_junk_when_junk double, p_junk_when_good double, p_abstain double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "score", "p_junk", "kept", "votes")


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
