"""Distances and patches on pixel tables (year, row, col): dense tiles of a bounded size, and runs of pixels instead of pixels.

Distances: the plane is cut into tiles; a place of the mask goes to its own tile and to those whose margin it lies in (at most
four). In a tile the transform is exact and has two passes: down the columns the rows to the nearest place, then along the rows
the lower envelope of the parabolas that these make, as far as `reach`. Rows per pixel don't depend on the radius.

Patches: a run is a stretch of places of a row, cut where tiles end. Edges join runs of neighbouring rows that overlap, so an
iteration carries runs; sizes and distances are interval arithmetic.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored
from .graph import components

PLACE = ["year", "row", "col"]
#: Rows and columns of a tile at least; wider margins take wider tiles, so that a place is in four tiles at most.
TILE = 256
#: Years above the places in a node's number.
PLACES = 1 << 44


def _side(reach: int) -> int:
    return max(TILE, 2 * reach + 2)


def _tiles_of(place: str, reach: int, side: int) -> Column:
    return F.array_distinct(F.array(*[F.floor((F.col(place) + d) / side).cast("int") for d in (-reach, 0, reach)]))


def _rows_to_nearest(mask: np.ndarray, far: int) -> np.ndarray:
    """By column, the rows to the nearest place of the mask, `far` where there is none."""
    n = len(mask)
    at = np.arange(n, dtype=np.int32)[:, None]
    above = np.maximum.accumulate(np.where(mask, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(mask, at, n + far)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(at - above, below - at), far)


def squared_distances(mask: np.ndarray, reach: int, disc: bool = True) -> np.ndarray:
    """Squared distance of each cell to the nearest True one (disc), or the larger of rows and columns apart; above reach**2 it's only a bound."""
    far = reach + 1
    down = _rows_to_nearest(mask, far)
    cost = down * down
    out = cost.copy()
    for step in range(1, reach + 1):
        for to, of in ((np.s_[:, step:], np.s_[:, :-step]), (np.s_[:, :-step], np.s_[:, step:])):
            np.minimum(out[to], cost[of] + step * step if disc else np.maximum(cost[of], step * step), out=out[to])
    return out


def _on_tiles(mask: DataFrame, reach: int, each, schema: str) -> DataFrame:
    """each(mask of the tile with its margin): columns of values for cells inside, with their rows and columns."""
    side = _side(reach)
    placed = mask.select("year", "row", "col", F.explode(_tiles_of("row", reach, side)).alias("_tr"), F.col("col").alias("_c"))
    placed = placed.select("year", "row", "col", "_tr", F.explode(_tiles_of("_c", reach, side)).alias("_tc"))

    def tile(table: pa.Table) -> pa.Table:
        year, top, left = (table.column(c)[0].as_py() for c in ("year", "_tr", "_tc"))
        dense = np.zeros((side + 2 * reach, side + 2 * reach), bool)
        dense[table.column("row").to_numpy() - top * side + reach, table.column("col").to_numpy() - left * side + reach] = True
        rows, cols, *values = each(dense)
        columns = [pa.array(np.full(len(rows), year, np.int32)), pa.array((rows + top * side).astype(np.int32)), pa.array((cols + left * side).astype(np.int32)), *map(pa.array, values)]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    cast = placed.withColumns({c: F.col(c).cast("int") for c in PLACE})
    return cast.groupBy("year", "_tr", "_tc").applyInArrow(tile, schema)


def distances(mask: DataFrame, reach: int, disc: bool = True) -> DataFrame:
    """(year, row, col, d2): places within `reach` of the mask, those of the mask too, with the squared distance to it."""

    def each(dense: np.ndarray):
        d2 = squared_distances(dense, reach, disc)[reach : len(dense) - reach, reach : len(dense) - reach]
        rows, cols = np.nonzero(d2 <= reach * reach)
        return rows, cols, d2[rows, cols].astype(np.int64)

    return _on_tiles(mask, reach, each, "year int, row int, col int, d2 long")


def depths(mask: DataFrame, reach: int, disc: bool = True) -> DataFrame:
    """(year, row, col, d2): places of the mask with the squared distance to the nearest place outside it, (reach + 1)**2 at most."""

    def each(dense: np.ndarray):
        inside = np.s_[reach : len(dense) - reach, reach : len(dense) - reach]
        d2 = squared_distances(~dense, reach, disc)[inside]
        rows, cols = np.nonzero(dense[inside])
        return rows, cols, np.minimum(d2[rows, cols], (reach + 1) ** 2).astype(np.int64)

    return _on_tiles(mask, reach, each, "year int, row int, col int, d2 long")


def near(mask: np.ndarray, reach: int) -> np.ndarray:
    """Cells within `reach` (a disc) of the mask's."""
    return squared_distances(mask, reach) <= reach * reach


def deep(mask: np.ndarray, reach: int) -> np.ndarray:
    """Cells of the mask farther than `reach` from all outside it."""
    return squared_distances(~mask, reach) > reach * reach


def combined(layers: list[DataFrame], reach: int, each) -> DataFrame:
    """(year, row, col): places where each(dense layers of a tile with its margin) holds; the layers' places alone are shuffled.

    `reach` is how far from a place its outcome depends on the layers: of steps one after the other, the sum of their reaches.
    """
    side = _side(reach)
    own = [df.select(*[F.col(c).cast("int").alias(c) for c in PLACE], F.lit(i).alias("_layer")).distinct() for i, df in enumerate(layers)]
    placed = reduce(DataFrame.unionByName, own).withColumn("_tr", F.explode(_tiles_of("row", reach, side))).withColumn("_tc", F.explode(_tiles_of("col", reach, side)))

    def tile(table: pa.Table) -> pa.Table:
        year, top, left = (table.column(c)[0].as_py() for c in ("year", "_tr", "_tc"))
        dense = np.zeros((count, side + 2 * reach, side + 2 * reach), bool)
        at = [table.column(c).to_numpy() for c in ("_layer", "row", "col")]
        dense[at[0], at[1] - top * side + reach, at[2] - left * side + reach] = True
        rows, cols = np.nonzero(each(*dense)[reach : side + reach, reach : side + reach])
        columns = [np.full(len(rows), year), rows + top * side, cols + left * side]
        return pa.Table.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names=PLACE)

    count = len(layers)
    # Sparse layers are few bytes, but each tile is work: partitions by number aren't put together by their size.
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartition(parts, "year", "_tr", "_tc")
    return spread.groupBy("year", "_tr", "_tc").applyInArrow(tile, "year int, row int, col int")


def runs(mask: DataFrame, *keep: str, side: int = TILE) -> DataFrame:
    """(year, row, first, last, keep...): stretches of places of a row with equal `keep`, cut at multiples of `side`; repeats are fine."""
    part = [F.col("year"), F.col("row"), F.floor(F.col("col") / side).cast("int"), *map(F.col, keep)]
    island = F.col("col") - F.row_number().over(Window.partitionBy(*part).orderBy("col"))
    found = mask.select(*PLACE, *keep).distinct().withColumn("_i", island).withColumn("_b", part[2])
    return found.groupBy("year", "row", "_b", "_i", *keep).agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_b", "_i")


def node(width: int, column: str) -> Column:
    return F.col("year").cast("long") * PLACES + F.col("row").cast("long") * width + F.col(column)


def patch_runs(mask: DataFrame, width: int, sides: int = 8) -> DataFrame:
    """(year, row, first, last, patch): runs of 8-neighbour (or 4-neighbour) components of a year, named by their smallest place."""
    own = stored(runs(mask).withColumn("u", node(width, "first")))  # read five times
    slack = 1 if sides == 8 else 0
    block = 64
    spans = F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block)))
    wide = F.explode(F.sequence(F.floor((F.col("first") - slack) / block), F.floor((F.col("last") + slack) / block)))
    below = own.select("year", (F.col("row") - 1).alias("row"), F.col("first").alias("f2"), F.col("last").alias("l2"), F.col("u").alias("v"), spans.alias("b"))
    above = own.select("year", "row", "first", "last", "u", wide.alias("b"))
    across = above.join(below, ["year", "row", "b"]).where((F.col("f2") <= F.col("last") + slack) & (F.col("l2") >= F.col("first") - slack))
    # Runs that were cut at a tile's end go on in the next column.
    cut = own.select("year", "row", F.col("u").alias("v"), F.col("first").alias("at"))
    along = own.select("year", "row", "u", (F.col("last") + 1).alias("at")).join(cut, ["year", "row", "at"])
    found = components(across.select("u", "v").unionByName(along.select("u", "v")))
    named = own.join(found.withColumnRenamed("node", "u"), "u", "left")
    return named.select("year", "row", "first", "last", F.pmod(F.coalesce("component", "u"), F.lit(PLACES)).alias("patch"))


def sizes(patched: DataFrame) -> DataFrame:
    """(year, patch, size) of runs."""
    return patched.groupBy("year", "patch").agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("size"))


def places(patched: DataFrame, *keep: str) -> DataFrame:
    """The places of runs."""
    return patched.select("year", "row", F.explode(F.sequence("first", "last")).alias("col"), *keep)


def to_point(row: float, col: float) -> Column:
    """Distance of a run's nearest place to a point."""
    # A point between two columns of a run is nearest to one of both.
    columns = [F.greatest(F.col("first"), F.least(F.col("last"), F.lit(int(np.floor(col)) + d))) for d in (0, 1)]
    return F.sqrt(F.pow(F.col("row") - row, 2) + F.pow(F.least(*[F.abs(c - F.lit(col)) for c in columns]), 2))


def _close(reach: float):
    least = int(np.floor(reach))

    def close(table: pa.Table) -> pa.Table:
        year = table.column("year")[0].as_py()
        row, first, last, patch, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "first", "last", "patch", "own"))
        order = np.lexsort((first, row))
        row, first, last, patch, own = (x[order].astype(np.int64) for x in (row, first, last, patch, own))
        base, span = first.min() - least - 1, int(last.max() - first.min()) + 2 * least + 3
        starts, ends = row * span + first - base, row * span + last - base
        mine, best = np.flatnonzero(own), {}
        for down in range(-least, least + 1):
            side = int(np.floor(np.sqrt(reach * reach - down * down)))
            line = (row[mine] + down) * span - base
            low = np.searchsorted(ends, line + first[mine] - side, "left")
            high = np.searchsorted(starts, line + last[mine] + side, "right")
            count = np.maximum(high - low, 0)
            a = np.repeat(mine, count)
            b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            differ = patch[a] != patch[b]
            a, b = a[differ], b[differ]
            if not len(a):
                continue
            gap = np.maximum(np.maximum(first[b] - last[a], first[a] - last[b]), 0)
            d2 = gap * gap + down * down
            pair = np.stack([np.minimum(patch[a], patch[b]), np.maximum(patch[a], patch[b])], 1)
            names, where = np.unique(pair, axis=0, return_inverse=True)
            shortest = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(shortest, where.ravel(), d2)
            for (p, q), d in zip(names.tolist(), shortest.tolist()):
                best[p, q] = min(d, best.get((p, q), d))
        keys = list(best)
        columns = [pa.array([year] * len(keys), pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([best[k] for k in keys], pa.int64())]
        return pa.Table.from_arrays(columns, names=["year", "a", "b", "d2"])

    return close


def near_patches(patched: DataFrame, reach: float) -> DataFrame:
    """(year, a, b, distance): pairs of patches of a year (runs, as of `runs` or `patch_runs`) whose nearest places are within `reach`.

    A run is looked at in its own tile with the runs of the tiles around that are within reach of it.
    """
    margin = int(np.ceil(reach))
    side = -(-max(TILE, margin) // TILE) * TILE  # a multiple of what runs are cut at: a run is in one tile
    here = patched.select(F.col("year").cast("int").alias("year"), "row", "first", "last", F.col("patch").cast("long").alias("patch"))
    own_r, own_c = (F.floor(F.col(c) / side).cast("int") for c in ("row", "first"))
    rows = F.explode(F.array_distinct(F.array(*[F.floor((F.col("row") + d) / side).cast("int") for d in (-margin, 0, margin)])))
    cols = F.explode(F.array_distinct(F.array(*[F.floor(c / side).cast("int") for c in (F.col("first") - margin, F.col("first"), F.col("last") + margin)])))
    sent = here.withColumns({"_or": own_r, "_oc": own_c}).withColumn("_tr", rows).withColumn("_tc", cols)
    sent = sent.withColumn("own", (F.col("_or") == F.col("_tr")) & (F.col("_oc") == F.col("_tc"))).drop("_or", "_oc")
    found = sent.groupBy("year", "_tr", "_tc").applyInArrow(_close(reach), "year int, a long, b long, d2 long")
    return found.groupBy("year", "a", "b").agg(F.sqrt(F.min("d2")).alias("distance"))
