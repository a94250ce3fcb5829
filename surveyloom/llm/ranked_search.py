"""Exact ranked search over posting lists in geometric blocks.

Documents become vectors of term counts and are dealt to shards of a bounded size by the signs of random projections, so that
similar documents meet. In a shard the posting list of each term is clustered: a few of its documents, evenly spread, are
representatives, and each document joins the one that its projected vector is most similar to. A cluster is a block; its
summary holds for every term the largest impact within the block, rounded up to a byte. A query goes through the lists of its
terms by falling weight; a block is skipped only if the bound from its summary is below the score of the k-th document known,
a list is left out only if all terms still to come can't reach that score, so nothing is lost. Results don't depend on blocks.

Queries are taken in blocks, as many as keep `TERMS` different terms; a block's terms are the coordinates of its index, because
summaries over all terms would grow with the square of a text's distinct terms. Statistics (documents, terms, documents per
term) cover all rows. Scores are 64-bit integers.

Edge cases: null and empty texts hold no terms and aren't counted; items without terms, or with terms that no document has, give
no rows; repeated documents are ranked each, repeated items are answered each; null ids of documents come last among ties; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, parallelism, table

#: Different terms and items of a block of queries. An item with more terms is a block of its own.
TERMS, ITEMS = 8192, 1024
#: Documents of a shard, and cells (documents x terms) at most; documents of a block of a posting list, about.
SHARD, CELLS, BLOCK = 4096, 1 << 26, 128
#: Documents of a posting list that has no summary but its own largest impact.
FEW = 16
#: Dimensions of the projection that similarity is judged by; its first signs deal documents to shards.
DIMENSIONS, SIGNS = 32, 16
#: Impacts are below 10**6; a summary holds them in steps of this, rounded up.
STEP = 4096
#: One shard in so many is searched first, to start the others with a score to beat.
FIRST = 8
_VECTOR = "doc_id long, n long, terms binary, counts binary, place int"
_SHARD = "shard long, doc_ids array<bigint>, pointer binary, terms binary, impacts binary, list_terms binary, list_most binary, list_edges binary, summary_at binary, members binary, block_edges binary, summaries binary"
_FOUND = "item long, doc_id long, score long"


def _term_bytes() -> bytes:
    """A-Z in small letters, bytes between terms as spaces; bytes of other code points stay."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[48:58] = np.arange(48, 58)
    out[97:123] = out[65:91] = np.arange(97, 123)
    return out.tobytes()


TERM_BYTES = _term_bytes()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def _projection(n: int) -> np.ndarray:
    return np.random.default_rng(12).standard_normal((n, DIMENSIONS)).astype(np.float32)


def _vectors(vocabulary: list[bytes]):
    """doc_id, n, numbers and counts of the vocabulary's terms, and the signs of the projected vector as a number."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        project, bits = _projection(len(vocabulary)), 1 << np.arange(SIGNS)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, ids, counts, places = [], [], [], []
                for text in part.column(1):
                    every = terms_of(text.as_py())
                    tally = Counter(every)
                    own = sorted((number[t], tally[t]) for t in tally.keys() & number.keys())
                    i, c = np.array(own, np.int64).reshape(-1, 2).T
                    sizes.append(len(every))
                    ids.append(i.astype("<u4").tobytes())
                    counts.append(c.astype("<u4").tobytes())
                    side = np.log2(1 + c).astype(np.float32) @ project[i, :SIGNS]
                    places.append(int(bits[side > 0].sum()))
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(places, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts", "place"])

    return vectors


def _holders(n_terms: int):
    """Documents per term of the rows of a task."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                held[np.frombuffer(ids.as_buffer(), "<u4")] += 1
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["term", "df"])

    return holders


def impacts(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by; counts and n (terms of the document): int64."""
    m = 25 + 75 * n * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Shard:
    """Documents with their vectors, and the posting lists of their terms in blocks."""

    #: List i has the term list_terms[i], the largest impact list_most[i], the blocks list_edges[i] to list_edges[i + 1] and summaries of
    #: them from summary_at[i] on, if it has more than FEW members; block j has the members from block_edges[j] on.
    PARTS = ("terms", "impacts", "list_terms", "list_most", "list_edges", "summary_at", "members", "block_edges")

    def __init__(self, doc_ids: list, pointer: np.ndarray, summaries: np.ndarray, **parts: np.ndarray):
        self.doc_ids, self.pointer, self.summaries = doc_ids, pointer, summaries
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def built(cls, doc_ids: list, pointer: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray) -> Shard:
        n, width = len(doc_ids), len(weights)
        rows = np.repeat(np.arange(n), np.diff(pointer))
        rounded = np.zeros((n, width), np.uint8)
        rounded[rows, terms] = -(-values // STEP)
        similar = np.zeros((n, DIMENSIONS), np.float32)
        project = _projection(width)
        for row, (a, b) in enumerate(zip(pointer[:-1].tolist(), pointer[1:].tolist())):
            similar[row] = (values[a:b] * weights[terms[a:b]]).astype(np.float32) @ project[terms[a:b]]
        similar /= np.maximum(np.linalg.norm(similar, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        list_terms, starts = np.unique(terms[order], return_index=True)
        most = np.maximum.reduceat(values[order], starts) if len(starts) else starts
        members, list_edges, summary_at, block_edges, summaries, made = [], [0], [], [0], [], 0
        for own in np.split(rows[order], starts[1:]) if len(list_terms) else []:
            own, ends = _blocks(own, similar)
            summary_at.append(made)
            if len(own) > FEW:
                summaries.append(np.maximum.reduceat(rounded[own], np.append(0, ends[:-1]), axis=0))
                made += len(ends)
            block_edges += [block_edges[-1] + e for e in ends.tolist()]
            list_edges.append(len(block_edges) - 1)
            members.append(own)
        whole = np.concatenate(summaries) if summaries else np.zeros((0, width), np.uint8)
        return cls(
            doc_ids, pointer, whole, terms=terms, impacts=values, list_terms=list_terms, list_most=most, list_edges=np.array(list_edges), summary_at=np.array(summary_at, np.int64),
            members=np.concatenate([np.zeros(0, np.int64), *members]), block_edges=np.array(block_edges),
        )

    def search(self, query: np.ndarray, k: int, to_beat: int) -> list[tuple[int, int]]:
        """(row, score) of the k best documents with a score above 0 and not below to_beat; more, where scores are equal."""
        asked = np.flatnonzero(query)
        at = np.searchsorted(self.list_terms, asked)
        here = at < len(self.list_terms)
        here[here] = self.list_terms[at[here]] == asked[here]
        asked, at = asked[here], at[here]
        most = self.list_most[at] * query[asked]
        order = np.argsort(-most, kind="stable")
        left = most.sum()
        seen, best = np.zeros(len(self.doc_ids), bool), np.zeros((0, 2), np.int64)
        for i in order.tolist():
            if left < max(to_beat, 1):
                break
            left -= most[i]
            first, last = int(self.list_edges[at[i]]), int(self.list_edges[at[i] + 1])
            start, end = int(self.block_edges[first]), int(self.block_edges[last])
            rows = self.members[start:end]
            if end - start > FEW:
                summary = int(self.summary_at[at[i]])
                bound = self.summaries[summary : summary + last - first, asked].astype(np.int64) @ query[asked] * STEP
                rows = rows[np.repeat(bound >= max(to_beat, 1), np.diff(self.block_edges[first : last + 1]))]
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            seen[rows] = True
            best = np.concatenate([best, np.stack([rows, self.scores(rows, query)], 1)])
            best = best[best[:, 1] >= max(to_beat, 1)]
            if len(best) > k:
                to_beat = max(to_beat, int(np.partition(best[:, 1], -k)[-k]))
                best = best[best[:, 1] >= to_beat]
        return [(int(r), int(s)) for r, s in best]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        length = self.pointer[rows + 1] - self.pointer[rows]
        edges = np.append(0, np.cumsum(length))
        at = np.arange(edges[-1]) + np.repeat(self.pointer[rows] - edges[:-1], length)
        sums = np.append(0, np.cumsum(self.impacts[at] * query[self.terms[at]]))
        return sums[edges[1:]] - sums[edges[:-1]]

    def row(self, shard: int) -> dict:
        parts = {name: getattr(self, name).astype("<u4").tobytes() for name in self.PARTS}
        packed = zstandard.ZstdCompressor(level=1).compress(self.summaries.tobytes())  # more than half of it is zeros
        return parts | {"shard": shard, "doc_ids": self.doc_ids, "pointer": self.pointer.astype("<i8").tobytes(), "summaries": packed}

    @classmethod
    def read(cls, row: dict, width: int) -> Shard:
        parts = {name: np.frombuffer(row[name], "<u4").astype(np.int64) for name in cls.PARTS}
        summaries = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["summaries"]), np.uint8).reshape(-1, width)
        return cls(row["doc_ids"], np.frombuffer(row["pointer"], "<i8"), summaries, **parts)


def _blocks(own: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in order of blocks, and where blocks end: clusters around evenly spread members, large ones in pieces."""
    n = -(-len(own) // BLOCK)
    if n == 1:
        return own, np.array([len(own)])
    lead = own[np.linspace(0, len(own) - 1, n).astype(np.int64)]
    cluster = (similar[own] @ similar[lead].T).argmax(1)
    order = np.argsort(cluster, kind="stable")
    _, first = np.unique(cluster[order], return_index=True)
    ends = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
        ends += [*range(a + 2 * BLOCK, b, 2 * BLOCK), b]
    return own[order], np.array(ends)


def _shards(weights: list[int], n_docs: int, n_terms: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array(weights, np.int64)
        size = max(1, min(SHARD, CELLS // max(1, len(weight))))

        def made(held: list) -> pa.RecordBatch:
            docs, n, terms, counts = zip(*held)
            length = np.array([len(t) // 4 for t in terms])
            ids = np.frombuffer(b"".join(terms), "<u4").astype(np.int64)
            values = impacts(np.frombuffer(b"".join(counts), "<u4").astype(np.int64), np.repeat(np.array(n, np.int64), length), n_docs, n_terms)
            shard = Shard.built(list(docs), np.append(0, np.cumsum(length)), ids, values, weight)
            first = int.from_bytes(np.random.default_rng([length.sum(), len(docs), int(ids[:64].sum())]).bytes(6), "little")
            return pa.RecordBatch.from_pylist([shard.row(first)], schema=_shard_schema())

        held = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts"))):
                held.append(row)
                if len(held) == size:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return shards


def _shard_schema() -> pa.Schema:
    names = [f.split()[0] for f in _SHARD.split(", ")]
    return pa.schema([(c, pa.int64() if c == "shard" else pa.list_(pa.int64()) if c == "doc_ids" else pa.binary()) for c in names])


def _searched(queries: list[dict[int, int]], to_beat: list[int], width: int, k: int):
    """Rows of `_FOUND` for every shard: its k best documents of each item (item: number within the block)."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, found = Shard.read(row, width), []
                for item, asked in enumerate(queries):
                    query = np.zeros(width, np.int64)
                    query[list(asked)] = list(asked.values())
                    hits = [(item, shard.doc_ids[r], s) for r, s in shard.search(query, k, to_beat[item])]
                    found += sorted(hits, key=lambda h: (-h[2], h[1] is None, h[1]))[:k]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item", "doc_id", "score"])

    return searched


def _answers(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of (item_id, terms with their counts)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, tally in items for t in tally})
    number = {t: i for i, t in enumerate(vocabulary)}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = materialise(texts.mapInArrow(_vectors(vocabulary), _VECTOR).where("n > 0"))
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    held = vectors.select("terms").mapInArrow(_holders(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = dict(held.collect())  # at most the block's terms
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) if i in df else 0 for i in range(len(vocabulary))]
    queries = [{number[t]: n * weights[number[t]] for t, n in tally.items() if weights[number[t]]} for _, tally in items]
    parts = max(parallelism(spark), -(-n_docs // SHARD))
    dealt = vectors.where(F.length("terms") > 0).repartitionByRange(parts, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    index = materialise(dealt.mapInArrow(_shards(weights, n_docs or 0, n_terms or 1), _SHARD))

    def found(rows: DataFrame, to_beat: list[int]) -> DataFrame:
        each = rows.mapInArrow(_searched(queries, to_beat, len(vocabulary), k), _FOUND)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    leads = F.pmod("shard", F.lit(FIRST)) == 0
    first = materialise(found(index.where(leads), [0] * len(items)))
    known = dict(first.where(F.col("rank") == k).select("item", "score").collect())  # a row an item
    rest = materialise(found(index.where(~leads), [known.get(i, 0) for i in range(len(items))]))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a row an item of the block


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tallies = [Counter(terms_of(t.as_py())) for t in batch.column(1)]
        arrays = [batch.column(0), pa.array([list(c) for c in tallies], pa.list_(pa.binary())), pa.array([list(c.values()) for c in tallies], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "terms", "counts"])


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item. docs: doc_id, text; items: item_id, text."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = asked.mapInArrow(_item_terms, "item_id long, terms array<binary>, counts array<bigint>").where(F.size("terms") > 0)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    block, known = [], set()
    for row in rows.toLocalIterator():
        tally = dict(zip(map(bytes, row["terms"]), row["counts"]))
        if block and (len(known | tally.keys()) > TERMS or len(block) == ITEMS):
            out, block, known = out.unionByName(_answers(docs, block, k)), [], set()
        block.append((row["item_id"], tally))
        known |= tally.keys()
    return out.unionByName(_answers(docs, block, k)) if block else out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = {"op12_ranked_search": """
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
size AS (SELECT d, doc_id, CAST(len(terms) AS BIGINT) AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM doc) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (d), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""}
QUERIES = {"op12_ranked_search": op12_ranked_search}
