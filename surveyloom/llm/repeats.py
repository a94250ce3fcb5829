"""Removal of repeated byte strings (suffix-array dedup) by bucket-pointer refinement on sampled suffixes.

A string of LENGTH bytes that also starts earlier (smaller id, or same document and earlier start) is removed; matches
never cross documents and overlapping copies count.

Full suffix arrays sort every offset. Here each LENGTH-byte string is represented by one suffix inside it, the GRAM-byte
gram of least hash, so equal strings choose the same suffix and one offset in about thirty is kept. The suffixes fall
into initial buckets by their gram; a suffix alone in its bucket is done. Members whose whole stretch (all strings that
the suffix represents) equals an earlier one's are copies: they go, and need no further look. Where a bucket still
holds different stretches, every offset in them gets a bucket pointer, first by its first 8 bytes, then refined by the
pointers at later offsets; each pass sorts only buckets of two or more, and its updated pointers are what the next pass
reads, so 8 bytes become 16, 32, 64 and LENGTH. These pointers are exact: equal pointers are equal bytes.

Copies of whole stretches are told by two 64-bit hashes (of the gram and, without arithmetic structure, of the stretch).
Buckets of more than MOST stretches are grouped by their strings' bytes in a distributed aggregation instead.

Edge cases: null and empty texts have no bytes and lose nothing (the hash of nothing); rows with equal id and text
(repeated rows) are one document and get the same result, in as many rows; rows that share an id but not the text are
ordered by a hash of it, null ids come first; other columns of `docs` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table
from .words import PrefixHash, U, blocks, mix, seeds, word_names

LENGTH = 100
GRAM = 32
PLACE = U((1 << 24) - 1)
PART = 1 << 23


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i, by block-wise running minima from both sides."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of starts of `length`-byte strings that share their sampled gram: row, first, count, place of the gram, and names."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U), none.astype(U)
    plain = PrefixHash(data)
    places = np.arange(len(data) - gram + 1)
    grams = mix(plain.names(places, places + gram))
    order = (mix(grams + U(99)) & ~PLACE) | places.astype(U)
    chosen = (sliding_minimum(order, length - gram + 1) & PLACE).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(chosen)]))
    at = chosen[starts]
    edge = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (np.diff(at) != 0))) if len(starts) else starts
    first = starts[edge]
    count = np.diff(np.append(edge, len(starts)))
    at = at[edge]
    row = np.searchsorted(offsets, first, "right") - 1
    name = mix(word_names(data, first, first + count - 1 + length, lower=False) + count.astype(U) * seeds(1, 55)[0])
    return row, first, count, at, grams[at], name


def _parts(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows as (first row, bytes before the block in its row, bytes, offsets); long rows come in parts that overlap."""
    for first, n, data, offsets in blocks(column):
        if len(data) <= PART:
            yield first, 0, data, offsets
            continue
        for row in range(n):  # a single row, unless it is that long
            own = data[offsets[row] : offsets[row + 1]]
            for at in range(0, max(1, len(own) - length + 1), PART):
                part = own[at : at + PART + length - 1]
                yield first + row, at, part, np.array([0, len(part)])


def _sampled(length: int, gram: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column(0).to_numpy()
            found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, U),) * 2]
            for first_row, ahead, data, offsets in _parts(batch.column(1), length):
                row, first, count, _, grams, name = segments(data, offsets, length, gram)
                found.append((base[first_row + row] + first - offsets[row] + ahead, count, grams, name))
            pos, count, grams, name = (np.concatenate(x) for x in zip(*found))
            # Copies within a batch are known to be copies now; they are dealt by position, so no key gathers them.
            order = np.lexsort((pos, name, grams))
            same = np.zeros(len(pos), bool)
            if len(pos):
                a, b = order[:-1], order[1:]
                start = np.append(True, (grams[a] != grams[b]) | (name[a] != name[b]))
                least = pos[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
                same[order] = pos[order] != least
            grams = np.where(same, mix(pos.view(U)), grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pos), pa.array(count.astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(name.view(np.int64)), pa.array(same)],
                names=["pos", "n", "gram", "name", "copy"],
            )

    return sampled


def _stretches(bits: int, length: int):
    """Rows (doc, text, places) to the bytes of each ambiguous stretch."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, low = (batch.column(1)[i].as_py() or "").encode(), (1 << bits) - 1
                rows = batch.column(2)[i].as_py()
                at = [r["pos"] & low for r in rows]
                columns = [[r[c] for r in rows] for c in ("pos", "n", "gram", "members")]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                arrays.append(pa.array([raw[a : a + n + length - 1] for a, n in zip(at, columns[1])], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["pos", "n", "gram", "members", "bytes"])

    return stretches


def bucket_pointers(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """A number for each offset, equal just for equal strings of `length` bytes; -1 where ends[offset] is nearer than that."""
    width = min(8, length)
    at = np.flatnonzero(np.arange(len(data)) + width <= ends)
    value = np.zeros(len(at), U)
    for b in range(width):
        value = (value << U(8)) | data[at + b].astype(U)
    pointer = np.full(len(data), -1)
    pointer[at] = _sorted_pointers(value)
    while width < length:
        step = min(width, length - width)
        fits = at + width + step <= ends[at]
        pointer[at[~fits]] = -2 - pointer[at[~fits]]  # too near the end to go on, but still read by others
        known = np.where(pointer < -1, -2 - pointer, pointer)
        at = at[fits]
        open_ = np.bincount(pointer[at], minlength=1)[pointer[at]] > 1
        some = at[open_]
        later = known[some + step]
        # A refined bucket's pointers lie from its first place on, which leaves all other buckets' pointers as they are.
        both = pointer[some] * len(data) + later
        order = np.argsort(both)
        both, old = both[order], pointer[some][order]
        new = np.append(True, both[1:] != both[:-1])[: len(old)]
        bucket = np.append(True, old[1:] != old[:-1])[: len(old)]
        place = np.arange(len(old))
        base = np.maximum.accumulate(np.where(bucket, place, 0))
        refined = np.empty(len(old), np.int64)
        refined[order] = old + np.maximum.accumulate(np.where(new, place, 0)) - base
        pointer[pointer < -1] = -1
        pointer[some] = refined
        width += step
    pointer[pointer < -1] = -1
    return pointer


def _sorted_pointers(value: np.ndarray) -> np.ndarray:
    """The first place of each value in sorted order."""
    order = np.argsort(value)
    first = np.append(True, value[order][1:] != value[order][:-1])[: len(value)]
    out = np.empty(len(value), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))
    return out


def _placed(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, end of its stretch for each byte, start and position of each LENGTH-byte string) of a batch of stretches."""
    n = batch.column("n").to_numpy().astype(np.int64)
    edges = np.append(0, np.cumsum(n + length - 1))
    data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
    ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(edges[:-1], n) + ahead
    return data, np.repeat(edges[1:], np.diff(edges)), start, np.repeat(batch.column("pos").to_numpy(), n) + ahead


def _refined(length: int):
    """Buckets in order of gram: positions of strings that stand earlier in their bucket too, as runs."""

    def refine(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, ends, start, pos = _placed(rows, length)
        pointer = bucket_pointers(data, ends, length)[start]
        least = np.full(len(data), np.iinfo(np.int64).max)
        np.minimum.at(least, pointer, pos)
        again = np.unique(pos[pos != least[pointer]])
        edge = np.flatnonzero(np.append(True, np.diff(again) != 1)) if len(again) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(again)))
        return pa.RecordBatch.from_arrays([pa.array(again[edge]), pa.array(count.astype(np.int32))], names=["pos", "n"])

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                gram = batch.column("gram").to_numpy()
                end = min(batch.num_rows, at + 8192)
                if size > 8192 and held:  # enough: end with the bucket that is open
                    last = held[-1].column("gram").to_numpy()[-1]
                    end = at + int(np.searchsorted(gram[at:], last, "right"))
                    if end == at:
                        yield refine(held)
                        held, size = [], 0
                        continue
                held.append(batch.slice(at, end - at))
                size += end - at
                at = end
        if held:
            yield refine(held)

    return refined


def _exploded(length: int):
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                data, _, start, pos = _placed(batch.slice(at, 1024), length)
                strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[start])
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(start), [None, pa.py_buffer(strings)])
                yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(pos)], names=["string", "pos"])

    return exploded


def _kept(bits: int, length: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, codes in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                removed = spans = 0
                if codes.is_valid:
                    code = codes.values.to_numpy()
                    first, count = code >> 24, code & ((1 << 24) - 1)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int((gone & ~np.append(False, gone[:-1])).sum())
                    raw_kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    raw_kept = raw
                rows.append((len(raw), removed, spans, raw_kept))
            n, removed, spans, left = zip(*rows) if rows else ((),) * 4
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return kept


def _ordinals(texts: DataFrame) -> DataFrame:
    """doc_id, print, doc: dense numbers in order of (doc_id, print), by range partitions and their sizes."""
    keys = texts.select("doc_id", "print").distinct().repartitionByRange("doc_id", "print").sortWithinPartitions("doc_id", "print")
    tagged = materialise(keys.withColumn("tag", F.monotonically_increasing_id()))
    part, place = F.shiftright("tag", 33), F.col("tag").bitwiseAND((1 << 33) - 1)
    sizes = tagged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return tagged.withColumn("part", part).join(F.broadcast(ahead), "part").select("doc_id", "print", (F.col("ahead") + place).alias("doc"))


def _numbered(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts with `doc`, a number in order of id, and the bits that a position in a text takes."""
    facts = texts.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.countDistinct("doc_id").alias("distinct"),
                      F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.octet_length("text")).alias("longest")).first()
    bits = max(1, int(facts["longest"] or 0).bit_length())
    unique = facts["n"] == facts["ids"] == facts["distinct"]
    if facts["n"] and unique and (facts["high"] - facts["low"]).bit_length() + bits <= 62:
        return texts.withColumn("doc", F.col("doc_id") - facts["low"]), bits
    own = F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("t.print").eqNullSafe(F.col("o.print"))
    return materialise(texts.alias("t").join(_ordinals(texts).alias("o"), own).select("t.*", "o.doc")), bits


#: Stretches of a bucket that one task refines; larger buckets' strings are grouped by all tasks. Results are the same.
MOST = 4096


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left, as binary), a row per row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("print"))
    texts, bits = _numbered(texts)
    placed = texts.select(F.shiftleft("doc", bits).alias("base"), "text")
    sampled = placed.mapInArrow(_sampled(length, gram), "pos long, n int, gram long, name long, copy boolean")
    bucket = Window.partitionBy("gram", "copy")
    ranked = sampled.withColumns({
        "again": F.col("copy") | (F.rank().over(Window.partitionBy("gram", "copy", "name").orderBy("pos")) > 1),
        "mixed": ~F.col("copy") & (F.min("name").over(bucket) < F.max("name").over(bucket)),
    })
    ranked = ranked.where("again or mixed").withColumn("members", F.when(F.col("mixed"), F.count("*").over(bucket)).otherwise(0))
    first = materialise(ranked.select("pos", "n", "gram", "again", "members"))

    doubtful = first.where("not again").groupBy(F.shiftright("pos", bits).alias("doc")).agg(F.collect_list(F.struct("pos", "n", "gram", "members")).alias("places"))
    with_text = doubtful.join(texts.select("doc", "text").dropDuplicates(["doc"]), "doc").select("doc", "text", "places")
    stretches = materialise(with_text.mapInArrow(_stretches(bits, length), "pos long, n int, gram long, members long, bytes binary"))
    small = stretches.where(F.col("members") <= most).repartition("gram").sortWithinPartitions("gram")
    runs = small.mapInArrow(_refined(length), "pos long, n int")
    strings = stretches.where(F.col("members") > most).mapInArrow(_exploded(length), "string binary, pos long")
    least = strings.groupBy("string").agg(F.min("pos").alias("least"))
    later = strings.join(least, "string").where("pos > least").select("pos", F.lit(1).alias("n"))
    gone = first.where("again").select("pos", "n").unionByName(runs).unionByName(later)
    code = F.shiftleft(F.col("pos").bitwiseAND((1 << bits) - 1), 24).bitwiseOR(F.col("n").cast("long"))
    per_doc = gone.groupBy(F.shiftright("pos", bits).alias("doc")).agg(F.collect_list(code).alias("codes"))
    rows = texts.join(per_doc, "doc", "left").select("doc_id", "text", "codes")
    return rows.mapInArrow(_kept(bits, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_repeats": op10_repeats}
