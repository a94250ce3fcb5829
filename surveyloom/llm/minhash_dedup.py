"""MinHash near-dedup with odd sketches.

A document's set is its distinct 5-word shingles (A-Z as a-z, words between white space); fewer words make one
shingle, none make none. Equal word sequences are one class, and the rest works on one member of each class. MinHash
samples of the set are banded into buckets; the same samples, folded into a parity bitmap (odd sketch), estimate the
similarity of a candidate pair from the population count of the bitmaps' XOR. Candidates that the estimate can't rule
out are confirmed on their full sets.

Inside a bucket not all pairs are made. Every member meets the bucket's leader (its smallest node); after that, only
buckets that still hold several components go on, in blocks of bounded size, and only pairs of different components
that pass the sketch are put out. So copies cost one pair each, and no link between components is lost.

Those pairs also pass a finer odd sketch: the shingles whose hash is below a bound (all of a set of fewer than
FINE_SAMPLE), folded into FINE_BITS of parity. The XOR's population count never exceeds the count of sampled shingles
that differ, so on whole sets it rules out no link.

A link at similarity s is met in no bucket with a probability of (1 - s**ROWS)**BANDS: 4e-7 at 0.85, 5e-5 at 0.8.

Edge cases: null and empty texts have empty sets and are linked with nothing (their own component, kept); rows that
share an id are one document as to links (their rows all come back, and what any of their texts is linked with); a null id can't be named in a group: its
component is null and it is kept; ties go to the smallest id; other columns of `docs` come back from `keep_one` and
are ignored by `near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table
from .components import components
from .words import LOWER, U, blocks, exact_grams, exact_ids, mix, row_shingles, seeds, word_names, word_spans

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 25, 5
SAMPLES = 128
#: Bits of an odd sketch, and how many standard errors below the threshold its estimate may lie.
SKETCH_BITS = 512
MARGIN = 5.0
#: Shingles that the finer sketch samples at most, its bits, and standard errors allowed where it holds a part of a set.
FINE_SAMPLE, FINE_BITS, FINE_MARGIN = 1024, 2048, 6.0
#: Members of a bucket whose block of pairs one task looks at.
BLOCK = 256
LOWER_BYTES = bytes(LOWER)
_SIGNED = "doc_id long, print long, n_shingles long, c1 long, c2 long, bands array<long>, sketch binary, fine binary"


def _level(sizes: np.ndarray) -> np.ndarray:
    """The finer sketch of a set of n shingles samples one in 2**level."""
    return np.log2(np.maximum(sizes // FINE_SAMPLE, 0.5)).astype(np.int64) + 1


def _fine(items: np.ndarray) -> bytes:
    """Packed parity of the samples at the set's own level and the next, which larger partners have."""
    own, out = int(_level(np.array([len(items)]))[0]), []
    for level in (own, own + 1):
        taken = items[items & U((1 << level) - 1) == 0]
        out.append(np.packbits((np.bincount((taken >> U(53)).astype(np.int64), minlength=FINE_BITS) & 1).astype(np.uint8)))
    return np.concatenate(out).tobytes()


def _minima(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """For blocks of rows: sizes of their sets, SAMPLES minima of 32-bit hashes (all ones for empty sets), finer sketches."""
    a = (seeds(SAMPLES, 5000) | U(1)).astype(np.uint32)
    b = (seeds(SAMPLES, 9000) >> U(32)).astype(np.uint32)
    for _, n, data, offsets in blocks(column, 1 << 18):
        starts, ends, pointer = word_spans(data, offsets)
        sets = list(row_shingles(word_names(data, starts, ends), pointer, SHINGLE))
        sizes = np.array([len(s) for s in sets])
        out = np.full((n, SAMPLES), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(sizes)
        if len(full):
            items = (np.concatenate([sets[i] for i in full]) >> U(32)).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for j in range(SAMPLES):
                out[full, j] = np.minimum.reduceat((items ^ b[j]) * a[j], at)
        yield sizes, out, [_fine(s) for s in sets]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = seeds(ROWS, 70) | U(1)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(2)
        sizes, bands, sketches, fine = [], [], [], []
        for n, minima, finer in _minima(texts):
            fine += finer
            sizes.append(n)
            wide = minima[:, : BANDS * ROWS].astype(U).reshape(len(n), BANDS, ROWS)
            names = mix((wide * factors).sum(axis=2, dtype=U) + seeds(BANDS, 300))
            bands.append(names.view(np.int64))
            place = mix(minima.astype(U) * U(SAMPLES) + np.arange(SAMPLES, dtype=U)) % U(SKETCH_BITS)
            bits = np.zeros((len(n), SKETCH_BITS), np.uint8)
            np.add.at(bits, (np.repeat(np.arange(len(n)), SAMPLES), place.ravel().astype(np.int64)), 1)
            sketches += [x.tobytes() for x in np.packbits(bits & 1, axis=1)]
        classes = np.zeros((len(ids), 2), np.int64)
        for i, text in enumerate(texts):
            raw = (text.as_py() or "").encode()
            digest = hashlib.blake2b(b" ".join(raw.translate(LOWER_BYTES).split()), digest_size=16).digest()
            classes[i] = np.frombuffer(digest, np.int64)
        if not len(ids):
            continue
        flat = np.concatenate(bands)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(1), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(classes[:, 0]), pa.array(classes[:, 1]), lists, pa.array(sketches, pa.binary()), pa.array(fine, pa.binary())],
            names=["doc_id", "print", "n_shingles", "c1", "c2", "bands", "sketch", "fine"],
        )


def _estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarities estimated from packed odd sketches (rows of bytes)."""
    differing = np.bitwise_count(np.bitwise_xor(x, y)).sum(axis=-1, dtype=np.int64)
    inside = np.maximum(1e-9, 1 - 2 * differing / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(inside)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - MARGIN * math.sqrt(s * (1 - s) / SAMPLES + (1 - s) / SAMPLES)


def _finely_plausible(n: int, fine: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n shingles may reach the threshold with each of the others, by finer sketches (2 levels x bytes)."""
    own, their = int(_level(np.array([n]))[0]), _level(sizes)
    level = np.maximum(own, their)
    known = np.abs(own - their) <= 1  # further apart only below a threshold of a half: not ruled out here
    a, b = np.where(known, level - own, 0), np.where(known, level - their, 0)
    differing = np.bitwise_count(fine[a] ^ others[np.arange(len(sizes)), b]).sum(axis=1, dtype=np.int64)
    most = (100 - percent) / (100 + percent) * (n + sizes) / 2.0**level
    most = np.where(level > 0, most + FINE_MARGIN * np.sqrt(most), most)
    return ~known | (differing <= most + 1e-6)


def _plausible(percent: int):
    @F.pandas_udf("boolean")
    def plausible(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = [np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y)]
        return pd.Series(_estimates(*rows) >= least_estimate(percent))

    return plausible


#: Bytes of pairs of texts that are confirmed together; a larger pair is alone.
CONFIRM_BYTES = 1 << 20


def _exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The texts' shingle sets as numbers that are equal only for equal words."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, pointer = word_spans(data, np.append(0, np.cumsum([len(t) for t in texts])))
    return exact_grams(exact_ids(data, starts, ends)[1], pointer, SHINGLE)


def _confirm(percent: int):
    """Pairs (u, v, tu, tv) whose full sets, told apart by their words' bytes, have 100 * common >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, at = [], 0
            while at < batch.num_rows:
                held, size = [], 0
                while at < batch.num_rows and (not held or size < CONFIRM_BYTES):
                    held += [(batch.column(c)[at].as_py() or "").encode() for c in (2, 3)]
                    size += len(held[-1]) + len(held[-2])
                    at += 1
                sets = _exact_sets(held)
                for x, y in zip(sets[::2], sets[1::2]):
                    c = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(c > 0 and 100 * c >= percent * (len(x) + len(y) - c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that are links. nodes: node, class_id, class_print; texts: doc_id, print, text."""
    both = pairs
    for side in "uv":
        both = both.join(nodes.select(F.col("node").alias(side), F.col("class_id").alias(f"i{side}"), F.col("class_print").alias(f"p{side}")), side)
    for side in "uv":
        both = both.join(texts.select(F.col("doc_id").alias(f"i{side}"), F.col("print").alias(f"p{side}"), F.col("text").alias(f"t{side}")), [f"i{side}", f"p{side}"])
    return both.select("u", "v", "tu", "tv").mapInArrow(_confirm(percent), "u long, v long")


def _sizes_allow(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _blocks_of_pairs(percent: int):
    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iat[0], frame["j"].iat[0]
        left, right = frame[frame["own"] == i], frame[frame["own"] == j]
        sketch = np.frombuffer(b"".join(right["sketch"]), np.uint8).reshape(len(right), -1)
        finer = np.frombuffer(b"".join(right["fine"]), np.uint8).reshape(len(right), 2, -1)
        size, out = right["n_shingles"].to_numpy(), []
        for node, comp, n, bits, fine in zip(left["node"], left["component"], left["n_shingles"], left["sketch"], left["fine"]):
            good = _estimates(np.frombuffer(bits, np.uint8)[None, :], sketch) >= least_estimate(percent)
            good &= (right["component"].to_numpy() != comp) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))
            at = np.flatnonzero(good)
            good[at] = _finely_plausible(n, np.frombuffer(fine, np.uint8).reshape(2, -1), size[at], finer[at], percent)
            out += [(min(node, x), max(node, x)) for x in right["node"].to_numpy()[good].tolist() if i != j or node < x]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return pairs


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with an id: doc_id, n_shingles, class_id, component_id, kept."""
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    signed = materialise(texts.mapInArrow(_signatures, _SIGNED))
    named = signed.where("doc_id is not null and n_shingles > 0")
    first_row = F.min(F.struct("doc_id", "print")).alias("_r")
    classes = named.groupBy("c1", "c2").agg(first_row).select("c1", "c2", F.col("_r.doc_id").alias("class_id"), F.col("_r.print").alias("class_print"))
    # Ids may repeat with other texts, so a class has a number of its own as its node, in order of ids: a bucket's leader is
    # its smallest id. Only these keys are sorted; the numbers are fixed once written.
    ordered = classes.repartitionByRange("class_id", "class_print").sortWithinPartitions("class_id", "class_print", "c1", "c2")
    classes = materialise(ordered.withColumn("node", F.monotonically_increasing_id()))
    reps = materialise(
        named.join(classes, ["c1", "c2"]).where("doc_id = class_id and print = class_print").dropDuplicates(["node"])
        .select("node", "class_id", "class_print", "n_shingles", "bands", "sketch", "fine")
    )
    nodes = reps.select("node", "class_id", "class_print")
    entries = reps.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = entries.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    buckets = materialise(entries.join(leaders, ["band", "key"]))
    facts = reps.select("node", "n_shingles", "sketch", "fine")

    met = buckets.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    for side in "uv":
        met = met.join(facts.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    met = met.where(_sizes_allow("nu", "nv", percent)).where(_plausible(percent)("su", "sv")).select("u", "v")
    links = materialise(_confirmed(met, nodes, texts.where("doc_id is not null"), percent))
    first = components(links)

    now = buckets.join(first.withColumnRenamed("component", "known"), "node", "left").select(
        "band", "key", "members", "node", F.coalesce("known", "node").alias("component")
    )
    mixed = now.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    # A bucket of two has had its one pair tested against the leader.
    rest = now.where("members > 2").join(mixed.select("band", "key"), ["band", "key"]).join(facts, "node")
    spread = (
        rest.withColumn("n", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    # Small buckets share tasks; (band, key, i, j) has about 2 * BLOCK rows at most.
    late = spread.groupBy("band", "key", "i", "j").applyInPandas(_blocks_of_pairs(percent), "u long, v long").distinct()
    more = _confirmed(late.join(met, ["u", "v"], "left_anti"), nodes, texts.where("doc_id is not null"), percent)
    every = links.unionByName(more)
    for side in "uv":
        every = every.join(nodes.select(F.col("node").alias(side), F.col("class_id").alias(f"i{side}")), side)
    # An id with several texts links their classes.
    member = named.select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "class_id"), ["c1", "c2"])
    several = member.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("low"), F.max(F.struct("c1", "c2")).alias("high")).where("low <> high")
    shared = member.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
    final = components(every.select(F.col("iu").alias("u"), F.col("iv").alias("v")).unionByName(shared))

    placed = classes.drop("node").join(final, F.col("class_id") == F.col("node"), "left").select(
        "c1", "c2", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    out = signed.select("doc_id", "n_shingles", "c1", "c2").join(placed.alias("p"), ["c1", "c2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents that are linked to one with a smaller id; null ids stay."""
    name = fresh("gone_id", docs.columns)
    marks = near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(marks, F.col(id_col) == F.col(name), "left_anti")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


ORACLE_SQL = {
    "op4_minhash_dedup": rf"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= {PERCENT} * (x.n + y.n - c)),
sym as (select u, v from e union all select v, u from e),
r as (select doc_id node, doc_id reach from d union select r.node, b.v from r join sym b on r.reach = b.u),
k as (select node, min(reach) component_id from r group by node),
c as (select w, min(doc_id) class_id from d where len(w) > 0 group by w),
l as (select list_transform(w, lambda x: x) w, class_id from c)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, k.component_id, k.component_id = d.doc_id kept, coalesce(l.class_id, d.doc_id) class_id
from d left join n on n.doc_id = d.doc_id join k on k.node = d.doc_id left join l on l.w = d.w""",
}
QUERIES = {"op4_minhash_dedup": op4_minhash_dedup}
