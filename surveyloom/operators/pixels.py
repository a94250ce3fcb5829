"""Per-pixel, neighbourhood, temporal and patch rules on pixel tables (year, row, col, bands); missing is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored
from . import raster
from .graph import components
from .quantiles import quantiles

PLACE = ["year", "row", "col"]
SIDE = 64  # rows and columns of a tile of observations


def _medians(bands: list[str]):
    def medians(table: pa.Table) -> pa.Table:
        keys = [x for c in PLACE for x in (table.column(c).is_null().to_numpy(), table.column(c).fill_null(0).to_numpy())]
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        out, counts = table.select(PLACE).take(pa.array(order[new])), []
        for c in bands:
            known = ~table.column(c).is_null().to_numpy()
            value, own = table.column(c).to_numpy()[known], group[known]
            value, n = value[np.lexsort((value, own))], np.bincount(own, minlength=len(out))
            start, some = np.cumsum(n) - n, n > 0
            low, high = (value[(start + i)[some]] for i in ((n - 1) // 2, n // 2))
            median = np.zeros(len(n))
            median[some] = np.where(low == high, low, 0.5 * low + 0.5 * high)
            out = out.append_column(c, pa.array(median, mask=~some))
            counts.append(n)
        return out.append_column("n_obs", pa.array(counts[0]))

    return medians


def composite(obs: DataFrame, bands: list[str]) -> DataFrame:
    """Median of each band and the observations by pixel and year; the count is that of the first band.

    Observations meet in small tiles, where all medians of a band come from one sort. All bands named are computed.
    """
    placed = obs.select(*PLACE, *[F.col(b).cast("double").alias(b) for b in bands])
    tile = [F.floor(F.col("row") / SIDE), F.floor(F.col("col") / SIDE), "year"]  # rows first: their sort tells most apart
    kinds = ", ".join([f"{c} {placed.schema[c].dataType.simpleString()}" for c in PLACE] + [f"{b} double" for b in bands] + ["n_obs long"])
    return placed.groupBy(*tile).applyInArrow(_medians(bands), kinds)


def gap_fill(grid: DataFrame, band: str, least: int, reach: int = 3) -> DataFrame:
    """Pixels with fewer than `least` observations take the mean of real ones at +-1, else +-2, else +-3 years; `filled` marks them."""
    real = grid.where(F.col("n_obs") >= least)
    sent = real.select("row", "col", band, F.explode(F.array(*[F.struct((F.col("year") + s * o).alias("year"), F.lit(o).alias("o")) for o in range(1, reach + 1) for s in (-1, 1)])).alias("t"))
    near = sent.groupBy("t.year", "row", "col").agg(*[F.avg(F.when(F.col("t.o") == o, F.col(band))).alias(f"_{o}") for o in range(1, reach + 1)])
    joined = grid.join(near, PLACE, "left")
    value = F.when(F.col("n_obs") >= least, F.col(band)).otherwise(F.coalesce(*[f"_{o}" for o in range(1, reach + 1)]))
    filled = (F.col("n_obs") < least) & value.isNotNull()
    return joined.select(*PLACE, value.alias(band), filled.alias("filled"))


def normalised_difference(a: str, b: str) -> Column:
    """(a - b) / (a + b), 0 where that isn't finite; null bands stay null."""
    return F.when(F.col(a) + F.col(b) == 0, 0.0).otherwise((F.col(a) - F.col(b)) / (F.col(a) + F.col(b)))


def local_std(grid: DataFrame, band: str, k: int, rows: int, cols: int) -> DataFrame:
    """Population standard deviation in a k x k window, mirrored at the border: each pixel sends its value to all windows it is in."""
    half = k // 2
    # A place in a window is a pixel itself or its mirror image, at -r - 1 or 2n - 1 - r; images further out are in no window.
    images = F.filter(F.array(*[F.struct(r.alias("r"), c.alias("c")) for r in _images("row", rows) for c in _images("col", cols)]), lambda x: x["r"].between(-half, rows - 1 + half) & x["c"].between(-half, cols - 1 + half))
    sent = grid.select("year", band, F.explode(images).alias("i")).select("year", band, "i.r", "i.c", F.explode(_square(half)).alias("o"))
    sent = sent.select("year", (F.col("r") + F.col("o.i")).alias("row"), (F.col("c") + F.col("o.j")).alias("col"), band)
    marked = sent.unionByName(grid.select(*PLACE, F.lit(None).cast("double").alias(band)).withColumn("_own", F.lit(1)), allowMissingColumns=True)
    sums = marked.groupBy(*PLACE).agg(F.avg(band).alias("m"), F.avg(F.col(band) * F.col(band)).alias("q"), F.max("_own").alias("_own")).where("_own = 1")
    return sums.select(*PLACE, F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("std"))


def _images(place: str, n: int) -> list[Column]:
    return [F.col(place), -F.col(place) - 1, 2 * n - 1 - F.col(place)]


def block_aggregate(grid: DataFrame, band: str, k: int = 3) -> DataFrame:
    return grid.groupBy("year", F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg(band).alias(band), F.count(band).alias("n"))


def replicate(blocks: DataFrame, band: str, k: int = 3) -> DataFrame:
    """A coarse table on the fine grid: each block's value at its k x k places."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(k)])
    fine = blocks.select("year", "row", "col", band, F.explode(steps).alias("o"))
    return fine.select("year", (F.col("row") * k + F.col("o.i")).alias("row"), (F.col("col") * k + F.col("o.j")).alias("col"), band)


def _square(radius: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])


def dilate(mask: DataFrame, radius: int = 1, disc: bool = False) -> DataFrame:
    """Places within `radius` (square, or disc) of a place of the mask (year, row, col), the border open."""
    return raster.distances(mask, radius, disc).select(*PLACE)


def erode(mask: DataFrame, radius: int = 1, disc: bool = False) -> DataFrame:
    """Places all of whose neighbours in the shape are in the mask."""
    return raster.depths(mask, radius, disc).where(F.col("d2") > radius * radius).select(*PLACE)


def opening(mask: DataFrame, rows: int, cols: int, radius: int = 1, disc: bool = False) -> DataFrame:
    """Erosion, then dilation; places nearer than `radius` to the border, where erosion sees half a shape, are put back."""
    opened = dilate(erode(mask, radius, disc), radius, disc)
    edge = (F.col("row") < radius) | (F.col("row") >= rows - radius) | (F.col("col") < radius) | (F.col("col") >= cols - radius)
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return opened.where(inside).unionByName(mask.where(edge).select(*PLACE)).distinct()


def majority3(grid: DataFrame, flag: str) -> DataFrame:
    """Of three years in a row; the first year needs the next one too, the last stays as it is. Years without a row break nothing."""
    own = Window.partitionBy("row", "col").orderBy("year")
    before, after = F.lag(flag).over(own), F.lead(flag).over(own)
    votes = before.cast("int") + F.col(flag).cast("int") + after.cast("int")
    value = F.when(after.isNull(), F.col(flag)).when(before.isNull(), F.col(flag) & after).otherwise(votes >= 2)
    return grid.withColumn("smooth", value)


def seal(grid: DataFrame, flag: str) -> DataFrame:
    """A pixel positive in two years in a row stays positive from the first of them on; other positives stay as they are."""
    own = Window.partitionBy("row", "col").orderBy("year")
    pair = F.coalesce(F.col(flag) & F.lead(flag).over(own), F.lit(False))
    lasting = F.max("_p").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return grid.withColumn("_p", pair).withColumn("sealed", lasting | F.coalesce(F.col(flag), F.lit(False))).drop("_p")


def first_year(grid: DataFrame, flag: str) -> DataFrame:
    return grid.where(flag).groupBy("row", "col").agg(F.min("year").alias("first"))


def patches(mask: DataFrame, width: int, sides: int = 8) -> DataFrame:
    """mask (year, row, col) with `patch`: 8-neighbour (or 4-neighbour) components within a year, named by their smallest place."""
    return raster.places(raster.patch_runs(mask, width, sides), "patch")


def with_size(patched: DataFrame) -> DataFrame:
    sizes = patched.groupBy("year", "patch").agg(F.count("*").alias("size"))
    return patched.join(sizes, ["year", "patch"])


def drop_small(mask: DataFrame, width: int, least: int) -> DataFrame:
    """The mask without patches of fewer than `least` pixels."""
    patched = stored(raster.patch_runs(mask, width))
    large = raster.sizes(patched).where(F.col("size") >= least)
    return raster.places(patched.join(large, ["year", "patch"], "left_semi"))


def fill_holes(mask: DataFrame, rows: int, cols: int, most: int) -> DataFrame:
    """The mask with holes of up to `most` pixels filled: 4-neighbour patches of the other pixels that don't touch the border."""
    whole = mask.select("year").distinct().select("year", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("year", "row", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    other = stored(whole.join(mask.select(*PLACE), PLACE, "left_anti"))
    holes = stored(raster.patch_runs(other, cols, sides=4))
    edge = F.col("row").isin(0, rows - 1) | (F.col("first") == 0) | (F.col("last") == cols - 1)
    inner = holes.groupBy("year", "patch").agg(F.max(edge).alias("edge")).where(~F.col("edge"))
    good = raster.sizes(holes).where(F.col("size") <= most).join(inner, ["year", "patch"])
    return mask.select(*PLACE).unionByName(raster.places(holes.join(good, ["year", "patch"], "left_semi")))


def near_patches(patched: DataFrame, reach: float) -> DataFrame:
    """(year, a, b, distance): pairs of patches of a year whose nearest pixels are within `reach`."""
    return raster.near_patches(raster.runs(patched, "patch"), reach)


def core_chain(patched: DataFrame, row: float, col: float, step: float, limit: float, start: float) -> DataFrame:
    """Pixels of patches that chain to the core: patches within `limit` of the core point, in steps of at most `step`.

    The core of a year is the patch whose nearest pixel to the point is nearest, if within `start`.
    """
    own = stored(raster.runs(patched, "patch"))
    reach = own.groupBy("year", "patch").agg(F.min(raster.to_point(row, col)).alias("far"))
    core = reach.where(F.col("far") <= start).groupBy("year").agg(F.min(F.struct("far", "patch")).alias("m")).select("year", F.col("m.patch").alias("core"))
    near = stored(own.join(reach.where(F.col("far") <= limit).select("year", "patch"), ["year", "patch"]))
    key = F.col("year").cast("long") * raster.PLACES
    found = components(raster.near_patches(near, step).select((key + F.col("a")).alias("u"), (key + F.col("b")).alias("v")))
    named = near.withColumn("node", key + F.col("patch")).join(found, "node", "left").withColumn("chain", F.coalesce("component", "node"))
    chains = named.join(core, "year")
    seat = chains.where("patch = core").select("year", F.col("chain").alias("seat")).distinct()
    return raster.places(chains.join(seat, "year").where("chain = seat"), "patch")


def small_and_near(patched: DataFrame, core: DataFrame, reach: float, most: int) -> DataFrame:
    """(year, patch, size, distance, near): patches outside the core, and whether they are small and within reach of it."""
    own = stored(raster.runs(patched, "patch"))
    sizes = raster.sizes(own)
    tagged = own.join(core.select("year", "patch").distinct().withColumn("_core", F.lit(True)), ["year", "patch"], "left")
    merged = tagged.withColumn("patch", F.when(F.col("_core"), F.lit(-1).cast("long")).otherwise(F.col("patch")))
    close = raster.near_patches(merged, reach).where("a = -1").select("year", F.col("b").alias("patch"), "distance")
    out = sizes.join(core.select("year", "patch").distinct(), ["year", "patch"], "left_anti").join(close, ["year", "patch"], "left")
    return out.withColumn("near", F.col("distance").isNotNull() & (F.col("size") <= most))


def mining_mask(mask: DataFrame, concessions: DataFrame, urban: DataFrame, radius: int, reach: int) -> DataFrame:
    """(row, col): mining seen in any year, widened by `radius`, with concession places within `reach` of it, without urban places."""
    def flat(df):
        return df.select(F.lit(0).alias("year"), "row", "col")

    def each(seen, conceded, built):
        d2 = raster.squared_distances(seen, max(radius, reach))
        return ((d2 <= radius * radius) | (conceded & (d2 <= reach * reach))) & ~built

    return raster.combined([flat(mask), flat(concessions), flat(urban)], max(radius, reach), each).select("row", "col")


def fuller_composite(obs: DataFrame, bands: list[str], least: int = 2, last: int = 1990) -> DataFrame:
    """composite() where years up to `last` whose median count is below `least` also take the observations of the years beside them."""
    own = obs.groupBy(*PLACE).agg(F.count(bands[0]).alias("n"))
    poor = own.groupBy("year").agg(F.median("n").alias("m")).where((F.col("m") < least) & (F.col("year") <= last)).select("year", F.explode(F.array(F.lit(-1), F.lit(1))).alias("o"))
    lent = poor.select(F.col("year").alias("to"), (F.col("year") + F.col("o")).alias("year"))
    borrowed = obs.join(F.broadcast(lent), "year").drop("year").withColumnRenamed("to", "year")  # two rows a year at most
    return composite(obs.select(*PLACE, *bands).unionByName(borrowed.select(*PLACE, *bands)), bands)


def spectral_indices(blue: str | None, green: str, red: str, nir: str, swir1: str, swir2: str) -> dict[str, Column]:
    """Eight indices by name; what isn't finite is 0, missing bands stay missing."""
    g, r, n, s = (F.col(x) for x in (green, red, nir, swir1))

    def over(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    ndvi, ndbi, mndwi, nbr2 = (normalised_difference(a, b) for a, b in ((nir, red), (swir1, nir), (green, swir1), (swir1, swir2)))
    savi = over(1.5 * (n - r), n + r + 0.5)
    lead = F.col(blue) if blue else F.lit(0.0)
    built = over(2 * s, s + n) - (over(n, n + r) + over(g, g + s))
    base = over(2 * s, s + n) + (over(n, n + r) + over(g, g + s))
    return {
        "ndvi": ndvi, "ndbi": ndbi, "mndwi": mndwi, "bui": ndbi - ndvi, "bsi": over((s + r) - (n + lead), (s + r) + (n + lead)), "savi": savi, "ibi": over(built, base), "nbr2": nbr2,
    }


def otsu(df: DataFrame, col: str, bins: int, low: float, high: float) -> DataFrame:
    """One row: the upper edge of the histogram bin where the variance between classes is largest (ties: the lowest)."""
    width = (high - low) / bins
    binned = df.where(F.col(col).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(col) - low) / width))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    own = Window.orderBy("bin")  # at most `bins` rows
    both = binned.select("bin", F.sum("n").over(own).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(own).alias("s0"), F.sum("n").over(Window.partitionBy()).alias("w"), F.sum(F.col("n") * F.col("bin")).over(Window.partitionBy()).alias("s"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    spread = both.where("w0 < w").withColumn("v", F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap)
    return spread.agg(F.min_by("bin", F.struct(-F.col("v"), "bin")).alias("bin")).select(F.lit(low) + (F.col("bin") + 1) * F.lit(width)).toDF("threshold")


def strata_accuracy(points: DataFrame, area: DataFrame, stratum: str, reference: str) -> DataFrame:
    """Per stratum of `area` (stratum, n_h, map): points seen, uncertain ones (a null reference; they are dropped), n, hits, share of the
    area w, share p of reference positives with its standard error, and the parts of the whole area that are positive and not.

    A stratum without a certain point has no p; one with a single point has no error.
    """
    seen = points.groupBy(stratum).agg(F.count("*").alias("seen"), F.count(reference).alias("n"), F.count_if(F.col(reference) == 1).alias("hits"))
    both = area.join(seen, stratum, "left").fillna(0, ["seen", "n", "hits"])
    w, p = F.col("n_h") / F.sum("n_h").over(Window.partitionBy()), F.try_divide("hits", "n")  # a row per stratum
    both = both.withColumns({"uncertain": F.col("seen") - F.col("n"), "w": w, "p": p})
    return both.withColumns({"se": F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("n") - 1)), "positive": F.col("w") * F.col("p"), "negative": F.col("w") * (1 - F.col("p"))})


def confusion_shares(strata: DataFrame) -> DataFrame:
    """(map, reference, share, points): estimated shares of the area by mapped and reference class, from `strata_accuracy`."""
    cells = F.array(F.struct(F.lit(True).alias("reference"), F.col("positive").alias("s"), F.col("hits").alias("k")), F.struct(F.lit(False).alias("reference"), F.col("negative").alias("s"), (F.col("n") - F.col("hits")).alias("k")))
    return strata.select("map", F.explode(cells).alias("c")).groupBy("map", "c.reference").agg(F.sum("c.s").alias("share"), F.sum("c.k").alias("points"))


def accuracy(strata: DataFrame, pixel_ha: float) -> DataFrame:
    """Area-weighted accuracy of a two-class map. strata: n_h (area in pixels), map (boolean), n, hits (reference positive).

    One row: overall, user's and producer's accuracy, adjusted area and its 95 % half-width in hectares.
    """
    total = F.sum("n_h").over(Window.partitionBy())  # a row per stratum
    w = strata.withColumn("w", F.col("n_h") / total).withColumn("p", F.col("hits") / F.col("n"))
    right = F.when(F.col("map"), F.col("p")).otherwise(1 - F.col("p"))
    out = w.agg(
        F.sum(F.col("w") * right).alias("overall"),
        (F.sum(F.when(F.col("map"), F.col("w") * F.col("p"))) / F.sum(F.when(F.col("map"), F.col("w")))).alias("users"),
        (F.sum(F.when(F.col("map"), F.col("w") * F.col("p"))) / F.sum(F.col("w") * F.col("p"))).alias("producers"),
        (F.sum(F.col("w") * F.col("p")) * F.sum("n_h") * pixel_ha).alias("area_ha"),
        (1.96 * F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / (F.col("n") - 1))) * F.sum("n_h") * pixel_ha).alias("half_ha"),
    )
    return out


def shape_metrics(mask: DataFrame, row: float, col: float) -> DataFrame:
    """By year: pixels, equivalent radius, mean and P95 distance to the origin, proximity index (mean distance of a disc of that
    area over the mean distance to the centroid), and how far and in what direction the centroid lies from the origin (0 is up,
    90 right)."""
    placed = mask.withColumn("far", F.sqrt(F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2)))
    centre = placed.groupBy("year").agg(F.count("*").alias("n"), F.avg("far").alias("mean_distance"), F.avg("row").alias("_r"), F.avg("col").alias("_c"))
    inside = F.sqrt(F.pow(F.col("row") - F.col("_r"), 2) + F.pow(F.col("col") - F.col("_c"), 2))
    spread = placed.join(centre, "year").groupBy("year").agg(F.avg(inside).alias("_own"))
    tail = quantiles(placed, ["year"], "far", {"p95": 0.95})
    radius = F.sqrt(F.col("n") / F.pi())
    down, right = F.col("_r") - row, F.col("_c") - col
    out = centre.join(spread, "year").join(tail, "year").withColumns({
        "radius": radius, "proximity": F.lit(2.0) / 3 * radius / F.col("_own"), "shift": F.sqrt(down * down + right * right), "azimuth": F.pmod(F.degrees(F.atan2(right, -down)), F.lit(360.0)),
    })
    return out.drop("_r", "_c", "_own")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two flags, as an aggregate; null where neither is ever set."""
    return F.try_divide(F.count_if(a & b), F.count_if(a | b))
