"""Token ids as packed binary matrices: best-fit-decreasing packing by a segment tree.

Documents become ids with a closing id 0. Every full stretch of `width` ids is a row of its own, written where it was
made; only the last, shorter stretch of each document is shuffled, into shards of a bounded count of stretches. In a
shard, stretches in order of falling length go to the open row with the least room that fits, found in a segment tree
over rooms. Rows of ids, cumulative segment lengths and positions that restart at each segment make the tables that
`write_matrices` stores; nothing is lost: `documents_back` rebuilds every document's ids.

Edge cases: a null or empty text is the closing id alone; each input row is packed, repeated rows too; null ids pass
through; ties go to the smaller id, then the earlier stretch; other columns of `docs` are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table
from .tokens import units, vocabulary_paths

WIDTH = 1024
#: How ids and positions stand in the matrices: unsigned 32-bit integers, little-endian, one after the other.
WRITTEN = "<u4"
#: Stretches that a shard has, about.
SHARD = 2048
#: Bytes of a row group of the written matrices.
GROUP_BYTES = 1 << 23
#: Rows of an Arrow batch while matrices are written and read back.
BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 256
_STRETCH = "doc_id long, source long, start long, doc_tokens long, ids binary"
_ROW = "shard long, row long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, sources array<bigint>, starts array<bigint>"
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_ROW_ARROW = pa.schema([
    ("shard", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", _INTS), ("position_ids", pa.binary()), ("doc_ids", _LONGS), ("sources", _LONGS), ("starts", _LONGS),
])
Each = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Rooms:
    """Counts of open rows by room, in a segment tree: the least room of at least n that some row has."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += change
            at //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, which leaves the tree; None if no row fits."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of indexes into lengths (each at most width)."""
    rooms, rows = Rooms(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = rooms.take(lengths[i])
        room, row = fit if fit else (width, len(rows))
        if not fit:
            rows.append([])
        rows[row].append(i)
        rooms.put(room - lengths[i], row)
    return rows


def stored_kind(paths: tuple[str, str]) -> str:
    """How ids are kept between steps: 16 bits if the whole vocabulary fits, else 32."""
    return "<u2" if len(units(*paths).width) <= 1 << 16 else "<u4"


def _stretches(json_path: str, ranks_path: str, width: int, stored: str):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = units(json_path, ranks_path)
        for batch in batches:
            docs, sources, starts, totals, raw, size = [], [], [], [], [], 0

            def made():
                arrays = [pa.array(x, pa.int64()) for x in (docs, sources, starts, totals)]
                return pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.binary())], names=["doc_id", "source", "start", "doc_tokens", "ids"])

            for doc, source, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), store.rows(batch.column(1))):
                ids = np.append(own, np.uint32(0)).astype(stored)
                for at in range(0, len(ids), width):
                    docs.append(doc)
                    sources.append(source)
                    starts.append(at)
                    totals.append(len(ids))
                    raw.append(ids[at : at + width].tobytes())
                    size += len(raw[-1])
                if size > 1 << 23:
                    yield made()
                    docs, sources, starts, totals, raw, size = [], [], [], [], [], 0
            if docs:
                yield made()

    return stretches


def _packed(width: int, each: Each, stored: str):
    def packed(stretches: pa.Table) -> pa.Table:
        frame: pd.DataFrame = stretches.to_pandas(integer_object_nulls=True)
        frame = frame.sort_values(["doc_id", "start", "source"], kind="stable", na_position="first").reset_index(drop=True)
        ids = [np.frombuffer(x, stored).astype(WRITTEN) for x in frame["ids"]]
        out = []
        for row, members in enumerate(best_fit_decreasing([len(x) for x in ids], width)):
            lengths = np.array([len(ids[i]) for i in members])
            edges = np.append(0, np.cumsum(lengths)).astype(np.int32)
            places = np.concatenate([np.arange(n, dtype=WRITTEN) for n in lengths])
            doc = [None if pd.isna(frame["doc_id"].iat[i]) else int(frame["doc_id"].iat[i]) for i in members]
            out.append((frame["shard"].iat[0], row, np.concatenate([ids[i] for i in members]).tobytes(), edges, places.tobytes(), doc, frame["source"].to_numpy()[members], frame["start"].to_numpy()[members]))
        rows = pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), _ROW_ARROW)], schema=_ROW_ARROW)
        return pa.Table.from_batches(each(iter(rows.to_batches())))

    return packed


def _full(each: Each, stored: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(x.as_py(), stored).astype(WRITTEN) for x in part.column("ids")]
                single = {c: pa.array([[x] for x in part.column(c).to_pylist()], _LONGS) for c in ("doc_id", "source", "start")}
                arrays = [
                    pa.array(np.full(len(ids), -1)), part.column("source"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([[0, len(x)] for x in ids], _INTS),
                    pa.array([np.arange(len(x), dtype=WRITTEN).tobytes() for x in ids], pa.binary()), single["doc_id"], single["source"], single["start"],
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=_ROW_ARROW)

    return lambda batches: each(rows(batches))


def matrices(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, paths: tuple[str, str] | None = None, each: Each = iter, kind: str = _ROW) -> DataFrame:
    """Packed rows: shard (-1: rows of one full stretch), row, ids, cu_seqlens, position_ids, doc_ids, sources, starts.

    `sources` number the input rows, so rows that share an id, or have none, stay apart. (shard, row) names a packed row; in
    shard -1, (row, starts[0]) does, and row is the source.
    `each` turns batches of these rows into batches of schema `kind` in the task that packs them, so that a summary
    of the rows doesn't send them through another step.
    """
    n_docs = docs.count()
    paths = paths or vocabulary_paths()
    stored = stored_kind(paths)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("source"))
    cut = materialise(texts.mapInArrow(_stretches(*paths, width, stored), _STRETCH))
    whole = F.length("ids") == np.dtype(stored).itemsize * width
    full = cut.where(whole).mapInArrow(_full(each, stored), kind)
    shards = max(1, -(-n_docs // shard))
    tails = cut.where(~whole).withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(shards)))
    return full.unionByName(tails.groupBy("shard").applyInArrow(_packed(width, each, stored), kind))


def write_matrices(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet in `path`, ids and positions as binary (WRITTEN); small row groups bound a task's memory."""
    rows.write.mode("errorifexists").option("parquet.block.size", str(GROUP_BYTES)).parquet(path)


def documents_back(rows: DataFrame) -> DataFrame:
    """source, doc_id, ids (binary as WRITTEN, with the closing 0) of every input row, from packed rows."""
    segments = rows.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "sources", "starts")).alias("i", "s"))
    part = F.expr("substring(ids, 4 * cu_seqlens[i] + 1, 4 * (cu_seqlens[i + 1] - cu_seqlens[i]))")
    parts = segments.select(F.col("s.sources").alias("source"), F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), part.alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.groupBy("source", "doc_id").agg(joined.alias("ids"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        def crc(name: str) -> pa.Array:
            return pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(name)], pa.int64())

        tokens = pa.array([len(x.as_buffer()) // 4 for x in batch.column("ids")], pa.int64())
        arrays = [batch.column("shard"), batch.column("row"), tokens, batch.column("doc_ids"), batch.column("starts"), batch.column("cu_seqlens"), crc("ids"), crc("position_ids")]
        yield pa.RecordBatch.from_arrays(arrays, names=["shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids_crc32", "positions_crc32"])


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices to the shared folder; the rows describe what is read back from the files."""
    path = f"{shared_dir(spark).rstrip('/')}/matrices/{uuid.uuid4().hex}"
    kind = "shard long, row long, n_tokens long, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long"
    usual = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH))  # a packed row has 8 kB and more
    try:
        write_matrices(matrices(table(spark, sf_dir, "documents")), path)
        return materialise(spark.read.schema(_ROW).parquet(path).mapInArrow(_digest, kind))
    finally:
        spark.conf.set(BATCH_CONF, usual)


QUERIES = {"op6_token_files": op6_token_files}
