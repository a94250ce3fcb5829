"""Packing by cutting-stock column generation.

Documents become token ids with a closing id 0 and are cut every `length` ids; only the last piece of a document can be
shorter. Piece lengths, rounded up to a grid, are counted over all documents: at most length / GRID counts reach the
driver, whatever the input. A linear program over packing patterns covers the counts with the fewest sequences; its
columns are priced by a knapsack dynamic program; solutions are rounded down and the few pieces left over are packed
first-fit-decreasing by count. Pieces are ranked within their class by a salted two-level count (no class lands in one
task) and ranks pick their place in a pattern from a broadcast table, whose size the grid bounds.

Edge cases: a null or empty text is the closing id alone; each input row is packed, repeated rows too; null ids pass
through; other columns of `docs` are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, parallelism, table
from .tokens import units, vocabulary_paths

LENGTH = 1024
GRID = 8
#: Columns generated at most; the solution so far is feasible at any time.
MAX_COLUMNS = 4000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(json_path: str, ranks_path: str, length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = units(json_path, ranks_path)
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), store.rows(batch.column(1))):
                ids = np.append(own, np.uint32(0)).astype("<u4", copy=False)
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_cut(*(paths or vocabulary_paths()), length), _PIECE)


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, by dynamic programming over it."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.flatnonzero(sizes <= room)
        if len(fits):
            gains = value[room - sizes[fits]] + prices[fits]
            best = int(np.argmax(gains))
            if gains[best] > value[room] + 1e-12:
                value[room], choice[room] = gains[best], fits[best]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def solve_cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) with every demand met exactly, near the fewest sequences. Sizes are distinct, demands positive."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(MAX_COLUMNS):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = _best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, pattern.astype(float))
        ratios = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        basis[:, out] = pattern
    times = np.floor(amount + 1e-9).astype(np.int64)
    columns = np.rint(basis).astype(np.int64)
    while ((columns @ times) > demand).any():  # rounding in floating point only
        over = int(np.argmax((columns @ times) - demand))
        times[int(np.argmax(columns[over] * (times > 0)))] -= 1
    plan = [(columns[:, j], int(times[j])) for j in range(m) if times[j]]
    left = demand - columns @ times
    order = np.argsort(-sizes)
    while left.any():  # the rest is fewer pieces than m patterns hold
        room, pattern = capacity, np.zeros(m, np.int64)
        for j in order:
            take = min(int(left[j]), room // int(sizes[j]))
            pattern[j] += take
            room -= take * int(sizes[j])
        left = left - pattern
        plan.append((pattern, 1))
    return plan


def _slots(spark: SparkSession, counts: dict[int, int], capacity: int) -> DataFrame:
    """Which ranks of a class go where: kind, low, high (ranks), each (of the class in a sequence), base (sequence)."""
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(s)] for s in sizes], np.int64)
    used, base, rows = np.zeros(len(sizes), np.int64), 0, []
    for pattern, times in solve_cutting_stock(sizes, demand, capacity):
        for j in np.flatnonzero(pattern).tolist():
            n = int(pattern[j]) * times
            rows.append((int(sizes[j]), int(used[j]), int(used[j]) + n, int(pattern[j]), base))
            used[j] += n
        base += times
    return spark.createDataFrame(rows, "kind int, low long, high long, each long, base long")


def pack(cut: DataFrame, length: int = LENGTH, grid: int = GRID) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` must be stored (it is read several times)."""
    spark = cut.sparkSession
    salts = 4 * parallelism(spark)
    keyed = cut.withColumns({"kind": F.ceil(F.col("length") / grid).cast("int"), "salt": F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))})
    cells = materialise(keyed.groupBy("kind", "salt").agg(F.count("*").alias("n")))
    counts = {r["kind"]: r["n"] for r in cells.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # length / grid rows at most
    slots = _slots(spark, counts, length // grid)
    earlier = Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.select("kind", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("kind", "salt").orderBy("doc_id", "start")
    ranked = keyed.withColumn("place", F.row_number().over(own) - 1).join(ahead, ["kind", "salt"]).withColumn("rank", F.col("ahead") + F.col("place"))
    placed = ranked.join(F.broadcast(slots), "kind").where("low <= rank and rank < high")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div each"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(pieces(table(spark, sf_dir, "documents"))))


QUERIES = {"op5_packing": op5_packing}
