"""Weighted totals, proportions, means and medians of cells, with household-bootstrap standard errors.

Values are summed by cell and household first; replicate multipliers (Rao-Wu: k - 1 of a stratum's k households drawn
with replacement, scaled by k / (k - 1)) are drawn by md5, so any engine draws the same. A household shuffles as one row with
its draws in an array and meets all its cells at once; tasks sum each cell's replicates as an array, and only these are shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored
from .quantiles import beside, bin_of, bounded, first_reaching, weighted_quantiles

REPLICATES = 200
MEDIAN_REPLICATES = 60
#: Replicates stay below it: what an entry of draws counts by.
DRAWN = 1 << 16
#: Households of a stratum group that share a bucket of draws; stratum groups; draws packed at once.
SPAN, STRATA, PACKED = 1024, 256, 1 << 22
#: Households whose multipliers are a matrix at once; doubles of cells' sums that a task holds before it passes them on.
ROWS, HELD = 2048, 1 << 22


def _pack(household: str, kind: str):
    """Draws (_at, _g, b) by bucket of SPAN places as arrays of place * DRAWN + b; rows of households (b null) go to their bucket."""
    schema = f"_g int, _u long, _l int, `{household}` {kind}, _k long, _e binary"

    def packed(g, at, b):
        bucket = (g << 44) | (at // SPAN)
        order = np.argsort(bucket, kind="stable")
        keys, starts = np.unique(bucket[order], return_index=True)
        entries = (((at % SPAN) * DRAWN + b)[order]).astype("<i4")
        ends = np.append(starts, len(entries)).astype(np.int32) * 4
        return keys, pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(entries)])

    def run(batches):
        held, n, own = [], 0, None
        for batch in batches:
            own = batch.schema.field(3).type
            table = pa.table(batch)
            mine = np.asarray(table["b"].is_null())
            if mine.any():
                some = table.filter(pa.array(mine))
                at = some["_at"].to_numpy()
                yield pa.RecordBatch.from_arrays([some["_g"].combine_chunks(), pa.array(at // SPAN), pa.array((at % SPAN).astype(np.int32)), some[household].combine_chunks(), some["_k"].combine_chunks(), pa.nulls(len(at), pa.binary())], names=["_g", "_u", "_l", household, "_k", "_e"])
            rest = table.filter(pa.array(~mine))
            held.append([rest[c].to_numpy().astype(np.int64) for c in ("_g", "_at", "b")])
            n += rest.num_rows
            if n >= PACKED:
                yield flushed(held, own)
                held, n = [], 0
        if n:
            yield flushed(held, own)

    def flushed(held, own):
        keys, entries = packed(*[np.concatenate(c) for c in zip(*held)])
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array((keys >> 44).astype(np.int32)), pa.array(keys & ((1 << 44) - 1)), pa.nulls(n, pa.int32()), pa.nulls(n, own), pa.nulls(n, pa.int64()), entries], names=["_g", "_u", "_l", household, "_k", "_e"])

    return run, schema


def _unpack(household: str, replicates: int):
    """(household, scale, draws) of a bucket: SPAN households at most, with the draws that hit them counted."""
    def run(table: pa.Table) -> pa.Table:
        mine = np.asarray(table["_l"].is_valid())
        entries = np.frombuffer(b"".join(table["_e"].filter(pa.array(~mine)).to_pylist()), "<i4")
        values, times = np.unique(entries, return_counts=True)
        some = table.filter(pa.array(mine))
        place, k = some["_l"].to_numpy().astype(np.int64), some["_k"].to_numpy().astype(np.int64)
        alone = k == 1  # every replicate has the only household of a stratum
        first = np.where(alone, len(values), np.searchsorted(values, place * DRAWN))
        length = np.where(alone, replicates, np.searchsorted(values, (place + 1) * DRAWN) - first)
        full = np.concatenate([times * DRAWN + values % DRAWN, DRAWN + np.arange(replicates)]).astype(np.int64)
        hit = length > 0
        first, length = first[hit], length[hit]
        ends = np.append(0, np.cumsum(length))
        picked = full[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
        scale = np.where(alone, 1.0, k / np.maximum(k - 1, 1))[hit]
        draws = pa.LargeListArray.from_arrays(ends, picked).cast(pa.list_(pa.int64()))
        return pa.table([some[household].filter(pa.array(hit)), pa.array(scale), draws], names=[household, "scale", "draws"])

    return run


def bootstrap_draws(households: DataFrame, household: str, stratum: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(household, scale, draws): a row per household. An entry of draws is a replicate and how often it draws the household, as
    `times` * DRAWN + b; replicates that leave it out aren't in it. A multiplier is `times` * scale.

    A null stratum is a stratum; a household of several strata is in the largest.
    """
    one = households.groupBy(household).agg(F.max(stratum).alias("_s")).withColumn("_s", F.coalesce(F.col("_s").cast("string"), F.lit("")))
    one = one.withColumn("_h", F.md5(F.col(household).cast("string"))).withColumn("_p", F.substring("_h", 1, 2))
    # Ranks follow the md5 of the household in 256 parts a stratum, so a large stratum is ranked by many tasks. Strata stand one after
    # the other in the places of their group (_g): a place _at is the stratum's first, _o, and the rank.
    spots = one.groupBy("_s", "_p").agg(F.count("*").alias("_n")).withColumn("_g", F.pmod(F.xxhash64("_s"), F.lit(STRATA)).cast("int"))
    ahead = Window.partitionBy("_g").orderBy("_s", "_p").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("_g", "_s")
    spots = spots.withColumn("_a", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select("_s", "_p", "_g", "_a", F.min("_a").over(own).alias("_o"), F.sum("_n").over(own).alias("_k"))
    inside = F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", household)) - 1
    ranked = one.withColumn("_i", inside).join(spots, ["_s", "_p"]).select(household, "_s", "_g", "_o", "_k", (F.col("_a") + F.col("_i")).alias("_at"))
    # The household of rank i makes the i-th draw of every replicate: k - 1 draws a stratum, spread like the households. Its own row
    # (b null) goes to its place's bucket with the draws that hit it, so households and draws are never joined; draws are shuffled packed.
    rank = F.col("_at") - F.col("_o")
    key = F.concat_ws("|", F.lit(str(seed)), "_s", "b", rank.cast("string"))
    hit = F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.col("_k"))
    # A household has many draws: they are spread by number, as few households would be put into one task.
    parts = int(households.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.when(rank > 0, F.sequence(F.lit(-1), F.lit(replicates - 1))).otherwise(F.array(F.lit(-1)))
    thrown = ranked.repartition(parts, household).select("*", F.explode(every).alias("b"))
    mine = F.col("b") < 0
    thrown = thrown.select(F.when(mine, F.col("_at")).otherwise(F.col("_o") + hit).alias("_at"), "_g", F.when(~mine, F.col("b")).alias("b"), F.when(mine, F.col(household)).alias(household), F.when(mine, F.col("_k")).alias("_k"))
    kind = thrown.schema[household].dataType.simpleString()
    buckets = thrown.mapInArrow(*_pack(household, kind)).groupBy("_g", "_u")
    return buckets.applyInArrow(_unpack(household, replicates), f"`{household}` {kind}, scale double, draws array<long>")


def _opened(weights: DataFrame, columns: list[str], draws: Column) -> DataFrame:
    """columns, b and m: a row per entry of draws."""
    each = weights.select(*columns, "scale", F.explode(draws).alias("_e"))
    return each.select(*columns, (F.col("_e") % DRAWN).cast("int").alias("b"), (F.floor(F.col("_e") / DRAWN) * F.col("scale")).alias("m"))


def bootstrap_weights(households: DataFrame, household: str, stratum: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """(household, b, m): households that a replicate draws, with their multiplier; households not drawn are left out."""
    return _opened(bootstrap_draws(households, household, stratum, replicates, seed), [household], F.col("draws"))


def drawn(sums: DataFrame, weights: DataFrame, household: str, replicates: int | None = None) -> DataFrame:
    """Rows of households once per replicate that draws them, with b and m; weights have a row per household or (b, m) as rows.

    Sizes of arrays and of rows made from them aren't known to the planner, which would broadcast them from the driver: weights are
    always merged.
    """
    if "draws" in weights.columns:
        kept = F.col("draws") if replicates is None else F.filter("draws", lambda e: e % DRAWN < replicates)
        return _opened(sums.join(weights.hint("merge"), household), sums.columns, kept)
    return sums.join((weights if replicates is None else weights.where(F.col("b") < replicates)).hint("merge"), household)


def household_rows(df: DataFrame, cell: list[str], household: str, weight: str, numerator: Column, denominator: Column) -> DataFrame:
    """_x and _d of every row, to be summed by cell and household once they are shuffled by household."""
    w = F.col(weight)
    return df.select(*cell, household, (w * numerator).alias("_x"), (w * denominator).alias("_d"))


def _sums_of_cells(fields: list[str]):
    """Sums of _x and _d by cell over batches of (scale, draws, cells): an array each, its first entry without multipliers, then one a replicate.

    An entry is null where the cell has no value. Cells that no longer fit are passed on; they are summed again after a shuffle.
    """
    def table(held, kinds):
        arrays = [pa.array([name[i] for name in held], kind) for i, kind in enumerate(kinds)]
        ends = np.append(0, np.cumsum([t.shape[1] for t in held.values()])).astype(np.int32)
        flat = np.concatenate(list(held.values()), axis=1)
        sums = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[i], mask=flat[i + 2] == 0)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays + sums, names=[*fields, "_x", "_d"])

    def run(batches):
        held, size, kinds = {}, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                scale, draws, cells = batch.slice(at, ROWS).columns
                n = len(scale)
                entries = draws.flatten().to_numpy()
                of = np.repeat(np.arange(n), draws.value_lengths().fill_null(0).to_numpy())
                b = entries % DRAWN
                m = np.zeros((n, int(b.max(initial=-1)) + 2))
                m[:, 0] = 1
                m[of, b + 1] = entries // DRAWN * scale.fill_null(0).to_numpy()[of]
                columns = cells.flatten().flatten()
                row = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
                kinds = [c.type for c in columns[:-2]]
                key = np.zeros(len(row), np.int64)
                for column in columns[:-2]:
                    coded = column.dictionary_encode()
                    _, key = np.unique(key * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(), return_inverse=True)
                order = np.argsort(key, kind="stable")
                _, starts = np.unique(key[order], return_index=True)
                names = list(zip(*[c.take(pa.array(order[starts])).to_pylist() for c in columns[:-2]]))
                values = np.stack([c.fill_null(0).to_numpy() for c in columns[-2:]] + [c.is_valid().to_numpy(zero_copy_only=False).astype(float) for c in columns[-2:]])
                odd = ~np.isfinite(values).all(axis=0)  # times 0 isn't 0
                for name, picked in zip(names, np.split(order, starts[1:])):
                    plain = picked[~odd[picked]]
                    block = values[:, plain] @ m[row[plain]]
                    for i in picked[odd[picked]]:
                        hit = m[row[i]] > 0
                        block[:, hit] += values[:, i, None] * m[row[i], hit]
                    old = held.get(name)
                    if old is None or old.shape[1] < block.shape[1]:
                        size += block.size - (0 if old is None else old.size)
                        if old is not None:
                            block[:, : old.shape[1]] += old
                        held[name] = block
                    else:
                        old[:, : block.shape[1]] += block
                if size >= HELD:
                    yield table(held, kinds)
                    held, size = {}, 0
        if held:
            yield table(held, kinds)

    return run


def replicate_sums(rows: DataFrame, weights: DataFrame, cell: list[str], household: str) -> DataFrame:
    """(cell, b, _x, _d): sums of _x and _d without multipliers (b = -1) and of each replicate. rows: cell, household, _x, _d, any number a household.

    Null where no household of the cell has a value or is drawn. Rows are shuffled by household once, whatever the number of cells.
    """
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("_x", "_d")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "draws" not in weights.columns:
        plain = rows.groupBy(*cell).agg(*sums).select(*cell, F.lit(-1).alias("b"), "_x", "_d")
        own = drawn(rows, weights, household).groupBy(*cell, F.col("b").cast("int").alias("b"))
        return plain.unionByName(own.agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in ("_x", "_d")]))
    own = rows.select(household, *cell, "_x", "_d").repartition(parts, household).groupBy(household, *cell).agg(*sums)
    own = own.groupBy(household).agg(F.collect_list(F.struct(*cell, "_x", "_d")).alias("_c"))  # a household's cells
    both = own.join(weights.hint("merge"), household, "left").select("scale", "draws", "_c")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cell).schema)
    summed = both.mapInArrow(_sums_of_cells(cell), f"{kinds}, _x array<double>, _d array<double>").repartition(parts, *cell)
    each = summed.select(*cell, F.posexplode(F.arrays_zip("_x", "_d"))).select(*cell, (F.col("pos") - 1).alias("b"), "col._x", "col._d")
    return each.groupBy(*cell, "b").agg(*sums)


def ratio_with_se(sums: DataFrame, weights: DataFrame, cell: list[str], household: str, total: bool = False) -> DataFrame:
    """value and se by cell: sum(_x) / sum(_d), or sum(_x) if `total`; null where the base is zero or less. sums: rows of households."""
    return with_se(replicate_sums(sums, weights, cell, household), cell, total)


def with_se(replicates: DataFrame, cell: list[str], total: bool = False) -> DataFrame:
    """value and se by cell of replicate_sums(); cells with a null have no se."""
    each = F.col("_x") if total else F.when(F.col("_d") > 0, F.col("_x") / F.col("_d"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell], F.col("b") >= 0)
    return replicates.groupBy(*cell).agg(F.max(F.when(F.col("b") < 0, each)).alias("value"), F.stddev_samp(F.when(known, each)).alias("se"))


def total(df, weights, cell, household, weight, mask: Column | None = None):
    return ratio_with_se(household_rows(df, cell, household, weight, (F.lit(1.0) if mask is None else F.coalesce(mask, F.lit(False)).cast("double")), F.lit(0.0)), weights, cell, household, True)


def proportion(df, weights, cell, household, weight, numerator: Column, base: Column | None = None):
    inside = F.lit(True) if base is None else F.coalesce(base, F.lit(False))
    top = (F.coalesce(numerator, F.lit(False)) & inside).cast("double")
    return ratio_with_se(household_rows(df, cell, household, weight, top, inside.cast("double")), weights, cell, household)


def mean(df, weights, cell, household, weight, y: str):
    known = df.where(F.col(y).isNotNull())
    return ratio_with_se(household_rows(known, cell, household, weight, F.col(y), F.lit(1.0)), weights, cell, household)


def weighted_median(df: DataFrame, cell: list[str], weight: str, y: str, q: float = 0.5) -> DataFrame:
    """The first value whose cumulative weight reaches half, or the share q (to nine digits)."""
    return weighted_quantiles(df, cell, weight, y, {"value": q})


def _replicate_medians(known: DataFrame, weights: DataFrame, cell: list[str], household: str, replicates: int) -> DataFrame:
    """cell, b and value: the weighted median of each replicate. known: cell, household, _y double, _w1.

    All replicates of a cell share the first range, so its bins are summed from rows on their way. Only rows between the least and the largest
    value of the bins that hold a median are kept by replicate and searched further.
    """
    known = stored(known)
    ends = known.groupBy(*cell).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    binned = beside(known, cell, ends).withColumn("_b", F.when(F.col("_lo") < F.col("_hi"), bin_of()).otherwise(0)).select(*cell, household, "_b", "_y", "_w1")
    weighted = F.col("_w1") * F.col("m")
    ends = stored(binned.groupBy(*cell, "_b").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")))
    sums = replicate_sums(binned.select("*", F.col("_w1").alias("_x"), F.lit(0.0).alias("_d")), weights, [*cell, "_b"], household)
    sums = beside(sums.where("b >= 0 and _x is not null").select(*cell, "b", "_b", F.col("_x").alias("_s")), [*cell, "_b"], ends)
    own = Window.partitionBy(*cell, "b")  # bins
    running = sums.withColumns({"_c": F.sum("_s").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_t": (0.5 - 1e-9) * F.sum("_s").over(own)})
    step = F.min(F.struct("_b", "_lo", "_hi", (F.col("_c") - F.col("_s")).alias("_base"), "_t")).alias("_m")
    targets = running.where((F.col("_t") > 0) & (F.col("_c") >= F.col("_t"))).groupBy(*cell, "b").agg(step)
    targets = stored(targets.select(*cell, "b", F.lit(0).alias("i"), "_m._t", "_m._base", "_m._lo", "_m._hi"))
    span = targets.groupBy(*cell).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    near = beside(known, cell, span).where(F.col("_y").between(F.col("_lo"), F.col("_hi"))).select(*known.columns)
    rows = stored(drawn(near, weights, household, replicates).select(*cell, "b", "_y", weighted.alias("_w")))
    return first_reaching(rows, [*cell, "b"], targets).drop("i")


def median_with_se(df, weights, cell, household, weight, y, replicates: int = MEDIAN_REPLICATES):
    known = df.select(*cell, household, bounded(F.col(y)).alias("_y"), F.col(weight).alias("_w1")).where("_y is not null and _w1 is not null")
    known = known.groupBy(*cell, household, "_y").agg(F.sum("_w1").alias("_w1"))
    if "draws" in weights.columns:  # read twice
        weights = stored(weights.withColumn("draws", F.filter("draws", lambda e: e % DRAWN < replicates)))
    se = _replicate_medians(known, weights, cell, household, replicates).groupBy(*cell).agg(F.stddev_samp("value").alias("se"))
    return beside(weighted_median(df, cell, weight, y), cell, se)


def sample_counts(df: DataFrame, cell: list[str], household: str) -> DataFrame:
    return df.groupBy(*cell).agg(F.count("*").alias("n"), F.countDistinct(household).alias("n_dom"))


def unpivot(df: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    """A row per dimension (dim, cat) of each record; null categories are left out."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("cat")) for d in dims])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.dim", "_p.cat").where("cat is not null")


def top_categories(df: DataFrame, cat: str, k: int = 30, other: str = "outros") -> DataFrame:
    """The k most frequent categories of an open list keep their names (ties by name); the rest become `other`."""
    ranked = df.where(F.col(cat).isNotNull()).groupBy(cat).count().orderBy(F.desc("count"), cat).limit(k).select(F.col(cat).alias("_top"))
    joined = df.join(F.broadcast(ranked), F.col(cat) == F.col("_top"), "left")  # k rows
    return joined.withColumn(cat, F.when(F.col(cat).isNotNull(), F.coalesce("_top", F.lit(other)))).drop("_top")
