"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become words (A-Z as a-z, ASCII separators). Their k-word seeds are joined in Spark; a pair
of a document and an item goes on only if the item's words that lie in shared seeds could reach the threshold, which
rules out no pair, as every tile is made of shared seeds. For the rest, running Karp-Rabin matching marks the longest
matches first, then shorter ones that don't overlap, down to k words; of a match that a longer one overlaps, the free
pieces of k words or more are matches in turn. The share of the item's words that are covered is compared with the
threshold, so reordered passages count in full.

The benchmark's seeds are collected to filter texts before the join only while there are at most MAX_FILTER; beyond
that all seeds of the texts are joined. Results are the same.

Edge cases: null and empty texts and items have no words and match nothing; items with fewer than k words are one seed
of all their words; rows with equal id and text (repeated rows) get the same result; null ids are kept apart by their
text; items that share an id count as one with the largest coverage, so items without an id do too (counted in
`n_items`, not named in `item_ids`); all columns of `docs` come back from `clean`; empty tables give every document as
clean.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, without
from .toxicity import SPLIT
from .words import LOWER, U, blocks, exact_ids, gram_names, mix, word_names, word_spans

K = 5
#: Covered share of an item's words, in percent, from which a document counts as contaminated.
PERCENT = 50
#: Length that Karp-Rabin starts from; longer matches are found by extension.
START = 20
MAX_FILTER = 1_000_000
#: Fixed values of the rolling hash: a prime modulus and the base.
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A3C5E7


def _named(column: pa.Array) -> Iterator[np.ndarray]:
    """The names of each text's words."""
    for _, _, data, offsets in blocks(column):
        start, end, pointer = word_spans(data, offsets, SPLIT)
        names = word_names(data, start, end)
        for a, b in zip(pointer[:-1].tolist(), pointer[1:].tolist()):
            yield names[a:b]


def _item_seeds(k: int):
    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, names in zip(batch.column(0).to_pylist(), _named(batch.column(1))):
                for m in {k, min(k, len(names))} - {0}:
                    if m == k or len(names) < k:
                        rows += [(item, len(names), i, m, x) for i, x in enumerate(gram_names(names, m).view(np.int64).tolist())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "n_words", "at", "width", "seed"])

    return item_seeds


def _text_seeds(widths: list[int], known: np.ndarray | None):
    def text_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found, width = [], [], []
            for _, n, data, offsets in blocks(batch.column(2)):
                start, end, pointer = word_spans(data, offsets, SPLIT)
                names = word_names(data, start, end)
                owner = np.repeat(np.arange(n), np.diff(pointer))
                for m in widths:
                    seeds = gram_names(names, m)
                    good = owner[: len(seeds)] == owner[m - 1 :] if len(seeds) else np.zeros(0, bool)
                    if known is not None and len(seeds):
                        good &= known[np.minimum(np.searchsorted(known, seeds), len(known) - 1)] == seeds if len(known) else False
                    at = np.flatnonzero(good)
                    pairs = np.unique(np.stack([owner[at].astype(U), seeds[at]]), axis=1) if len(at) else np.zeros((2, 0), U)
                    row.append(pairs[0].astype(np.int64) + _)
                    found.append(pairs[1].view(np.int64))
                    width.append(np.full(pairs.shape[1], m))
            if not row:
                continue
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(width)), pa.array(np.concatenate(found))],
                names=["doc_id", "print", "width", "seed"],
            )

    return text_seeds


def rolling_hashes(words: list[int], length: int) -> Iterator[int]:
    """Karp-Rabin: the hash of each stretch of `length` words from that of the one before."""
    if length > len(words):
        return
    lead, value = pow(BASE, length - 1, MODULUS), 0
    for i, word in enumerate(words):
        if i >= length:
            value -= (words[i - length] + 2) * lead
        value = (value * BASE + word + 2) % MODULUS
        if i >= length - 1:
            yield value


def greedy_tiles(text: list[int], item: list[int], k: int = K, start: int = START) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, length) of tiles: longest matches first, none overlapping another.

    Stretches meet by rolling hash; a match counts once its words are equal.
    """
    k = min(k, len(item))
    tiles, used_t, used_i = [], [False] * len(text), [False] * len(item)
    length = max(k, min(start, len(item)))
    while k and length >= k:
        places = defaultdict(list)
        for j, value in enumerate(rolling_hashes(item, length)):
            if not any(used_i[j : j + length]):
                places[value].append(j)
        matches, longest = [], 0
        for i, value in enumerate(rolling_hashes(text, length)) if places else ():
            for j in places.get(value, ()):
                if text[i : i + length] != item[j : j + length]:
                    continue
                if used_t[i] or used_t[i + length - 1] or any(used_t[i : i + length]):
                    break
                if i and j and text[i - 1] == item[j - 1] and not used_t[i - 1] and not used_i[j - 1]:
                    continue  # part of the match that starts one word before
                n = length
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used_t[i + n] and not used_i[j + n]:
                    n += 1
                matches.append((-n, i, j))
                longest = max(longest, n)
        if longest > 2 * length:  # a much longer match: scan again from its length
            length = longest
            continue
        heapq.heapify(matches)
        while matches:
            n, i, j = heapq.heappop(matches)
            n = -n
            if not any(used_t[i : i + n]) and not any(used_i[j : j + n]):
                used_t[i : i + n] = [True] * n
                used_i[j : j + n] = [True] * n
                tiles.append((i, j, n))
                continue
            # What longer tiles left free of it is a match again; pieces below this length are found at the next ones.
            free = 0
            for at in range(n + 1):
                if at < n and not used_t[i + at] and not used_i[j + at]:
                    free += 1
                    continue
                if free >= length:
                    heapq.heappush(matches, (-free, i + at - free, j + at - free))
                free = 0
        if length == k:
            break
        length = max(k, length // 2)
    return tiles


def _numbered(text: bytes, item: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers of words that are equal only for words of equal bytes."""
    data = LOWER[np.frombuffer(text + item, np.uint8)]
    start, end, pointer = word_spans(data, np.array([0, len(text), len(data)]), SPLIT)
    ids = exact_ids(data, start, end)[1]
    return ids[: pointer[1]], ids[pointer[1] :]


def _near(text: np.ndarray, item: np.ndarray, k: int) -> list[int]:
    """The text's words that lie in seeds shared with the item; a break stands between stretches (-1 matches nothing)."""
    k = min(k, len(item))
    inside = np.zeros(len(text) + k, bool)
    hits = np.flatnonzero(np.isin(gram_names(mix(text.astype(U)), k), gram_names(mix(item.astype(U)), k)))
    for shift in range(k):
        inside[hits + shift] = True
    at = np.flatnonzero(inside[: len(text)])
    out, last = [], None
    for i, x in zip(at.tolist(), text[at].tolist()):
        if last is not None and i != last + 1:
            out.append(-1)
        out.append(x)
        last = i
    return out


def _covered(k: int):
    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for text, item in zip(batch.column(3), batch.column(4)):
                text, item = _numbered((text.as_py() or "").encode(), (item.as_py() or "").encode())
                tiles = greedy_tiles(_near(text, item, k), item.tolist(), k)
                share.append(sum(n for _, _, n in tiles) / len(item) if len(item) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], names=["doc_id", "print", "item_id", "coverage"])

    return covered


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, k: int = K, most: int = MAX_FILTER) -> DataFrame:
    """doc_id, print (hash of the text), item_id, coverage of every contaminated pair. benchmark: item_id, text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text").cast("string").alias("text"))
    seeds = materialise(items.mapInArrow(_item_seeds(k), "item_id long, n_words long, at long, width long, seed long"))
    distinct = seeds.select("width", "seed").distinct()
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # k at most
    known = None
    if distinct.limit(most + 1).count() <= most:
        known = np.unique(distinct.select("seed").toArrow().column(0).to_numpy().view(U))
    shared = texts.mapInArrow(_text_seeds(widths, known), "doc_id long, print long, width long, seed long").distinct()
    joined = shared.join(seeds, ["width", "seed"])
    # Tiles lie in shared seeds: the union of [at, at + width) bounds what they can cover.
    places = joined.groupBy("doc_id", "print", "item_id", "n_words").agg(F.array_sort(F.collect_set("at")).alias("places"), F.first("width").alias("width"))
    union = F.expr(
        "aggregate(places, named_struct('last', -width, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(width, x - a.last)), a -> a.n)"
    )
    likely = places.where(100 * union >= percent * F.col("n_words")).select("doc_id", "print", "item_id")
    named = items.select(F.col("item_id").alias("_item"), F.col("text").alias("item"))
    pairs = likely.join(named, F.col("item_id").eqNullSafe(F.col("_item"))).alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p.print") == F.col("d.print"))
    both = pairs.join(texts.alias("d"), same)
    tiled = both.select("p.doc_id", "p.print", "p.item_id", "d.text", "p.item").mapInArrow(_covered(k), "doc_id long, print long, item_id long, coverage double")
    hit = tiled.where(100 * F.col("coverage") >= percent)
    return hit.groupBy("doc_id", "print", "item_id").agg(F.max("coverage").alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` without contaminated documents."""
    gone = matches(docs, benchmark, percent).select("doc_id", "print").distinct()
    return without(docs, gone)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id", "print").agg(
        F.count("*").alias("n_items"), F.max("coverage").alias("coverage"), F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids")
    )
    marks = docs.select("doc_id", F.xxhash64("text").alias("print")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.print") == F.col("f.print"))
    return marks.join(found.alias("f"), same, "left").select(
        "d.doc_id",
        F.coalesce("f.n_items", F.lit(0)).alias("n_items"),
        F.round(F.coalesce("f.coverage", F.lit(0.0)), 6).alias("coverage"),
        F.coalesce("f.item_ids", F.lit("")).alias("item_ids"),
        F.col("f.n_items").isNotNull().alias("contaminated"),
    )


QUERIES = {"op8_decontamination": op8_decontamination}
