"""Measures over pixel tables, series and categories: seasons, slope, mosaics, agreement, display groups, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def borrowed_maximum(df: DataFrame, keys: list[str], year: str, value: str, least: int) -> DataFrame:
    """Yearly maximum per key; years with fewer than `least` rows take the maximum of the years within one as well."""
    yearly = df.groupBy(*keys, year).agg(F.max(value).alias("own"), F.count(value).alias("n"))
    near = F.max("own").over(Window.partitionBy(*keys).orderBy(year).rangeBetween(-1, 1))
    return yearly.select(*keys, year, F.when(F.col("n") < least, near).otherwise(F.col("own")).alias(value))


def slope_degrees(grid: DataFrame, row: str, col: str, z: str, cell: float) -> DataFrame:
    """Slope by central differences; null where one of the four neighbours is missing. One row per pixel is expected."""
    def step(line: str, along: str) -> Column:
        own = Window.partitionBy(line).orderBy(along)
        return (F.max(z).over(own.rangeBetween(1, 1)) - F.max(z).over(own.rangeBetween(-1, -1))) / (2 * cell)

    steps = grid.withColumns({"_dx": step(row, col), "_dy": step(col, row)})
    return steps.select(row, col, F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))).alias("slope"))


def mosaic(df: DataFrame, keys: list[str], value: str, order: list[str], valid: Column) -> DataFrame:
    """The valid value of the last tile wins; the largest value of tiles that tie."""
    return df.where(valid).groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def binary_scores(df: DataFrame, keys: list[str], mapped: Column, reference: Column) -> DataFrame:
    """Overall, user's and producer's accuracy and F1 of a binary map; null where a share has no base."""
    n = lambda test: F.count_if(test)
    counts = df.groupBy(*keys).agg(n(mapped & reference).alias("tp"), n(mapped & ~reference).alias("fp"), n(~mapped & reference).alias("fn"), n(~mapped & ~reference).alias("tn"))
    c = F.col
    return counts.select(
        *keys,
        F.try_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("oa"),
        F.try_divide(c("tp"), c("tp") + c("fp")).alias("ua"),
        F.try_divide(c("tp"), c("tp") + c("fn")).alias("pa"),
        F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
    )


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum in the order of a hash of the key, with the stratum's size."""
    own = Window.partitionBy(stratum)
    placed = df.withColumn("_r", F.row_number().over(own.orderBy(F.md5(F.col(key).cast("string")), key)))
    return placed.where(F.col("_r") <= n).drop("_r").join(df.groupBy(stratum).agg(F.count("*").alias("size")), stratum)


def agreement(series: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation and median ratio of two series, over the steps that have both."""
    both = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.median(F.try_divide(F.col(y), F.col(x))).alias("ratio"))


def drops(series: DataFrame, keys: list[str], order: str, value: str, tolerance: float) -> DataFrame:
    """Steps at which a series falls by more than a share of the step before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("before", before).where(F.col(value) < (1 - tolerance) * F.col("before"))


def stacked_groups(df: DataFrame, keys: list[str], group: str, weight: str) -> DataFrame:
    """Sums of display groups with the offset at which each starts when stacked in order of its name."""
    sums = df.groupBy(*keys, group).agg(F.sum(weight).alias("total"))
    upto = F.sum("total").over(Window.partitionBy(*keys).orderBy(group))
    return sums.withColumn("offset", upto - F.col("total"))


def numbered_slugs(df: DataFrame, base: Column, key: str) -> DataFrame:
    """Slugs by base; where several rows share a base, they are numbered from 1 in order of the key."""
    counted = df.withColumn("_b", base)
    number = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    shared = counted.groupBy("_b").agg((F.count("*") > 1).alias("_many"))
    out = counted.withColumn("_i", number).join(shared, "_b")
    return out.withColumn("slug", F.when(F.col("_many"), F.concat_ws("_", "_b", F.col("_i").cast("string"))).otherwise(F.col("_b"))).drop("_b", "_i", "_many")
