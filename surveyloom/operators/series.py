"""Ordered series: change, lags, runs, anchors, interpolation, ranks, period sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored
from .quantiles import beside


def change(df: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    """`diff` and `pct` against the row before; null for the first, and for a zero base."""
    before = F.lag(col).over(Window.partitionBy(*part).orderBy(order))
    return df.withColumns({"diff": F.col(col) - before, "pct": F.try_divide(100 * (F.col(col) - before), before)})


def ranked(df: DataFrame, part: list[str], col: str, out: str = "rank") -> DataFrame:
    """df with the rank of `col` inside `part`, from 1 with ties averaged. Rows without a value are left out; null is a group as any.

    Rows are counted by value first. Distinct values are dealt by range over all tasks and written once; the counts ahead of a
    range (a row per group and range) and those ahead inside it give the rank, which is joined back by value. So no task holds
    the values of a group. Rows are written first: sums of doubles computed anew may end in other digits and not meet their rank.
    """
    known = stored(df.where(F.col(col).isNotNull()))
    counts = known.groupBy(*part, col).agg(F.count("*").alias("_n")).repartitionByRange(*part, col)
    ranges = stored(counts.withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy(*part, "_range").agg(F.sum("_n").alias("_t"))
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*part, "_range", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_ahead"))
    inside = F.sum("_n").over(Window.partitionBy(*part, "_range").orderBy(col)) - F.col("_n")
    placed = beside(ranges.withColumn("_inside", inside), [*part, "_range"], ahead)
    places = placed.select(*part, col, (F.col("_ahead") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(out))
    return beside(known, [*part, col], places)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where either side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def lagged_correlation(df: DataFrame, part: str, order: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """Per series and lag: n, Pearson and Spearman of y with x `lag` rows before."""
    over = Window.partitionBy(part).orderBy(order)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("x")) for k in lags]))
    wide = df.select(part, F.col(y).alias("y"), *[F.lag(x, k).over(over).alias(f"_x{k}") for k in lags])
    pairs = wide.select(part, "y", rows.alias("p")).select(part, "y", "p.lag", "p.x").where("x is not null and y is not null")
    both = ranked(ranked(pairs, [part, "lag"], "x", "rx"), [part, "lag"], "y", "ry")
    return both.groupBy(part, "lag").agg(F.count("*").alias("n"), correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"))


def runs(df: DataFrame, part: list[str], order: str, condition: Column) -> DataFrame:
    """Stretches of consecutive integers of `order` where the condition holds: start, end, length."""
    own = Window.partitionBy(*part).orderBy(order)
    kept = df.where(condition).select(*part, order).distinct().withColumn("_g", F.col(order) - F.row_number().over(own))
    return kept.groupBy(*part, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("_g")


def anchor_pairs(df: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    own = Window.partitionBy(*part).orderBy(order)
    return df.select(*part, F.col(order).alias("t0"), F.lead(order).over(own).alias("t1"), F.col(col).alias("v0"), F.lead(col).over(own).alias("v1")).where("t1 is not null")


def geometric_interpolate(spine: DataFrame, part: list[str], order: str, known: str, scale: str | None = None) -> DataFrame:
    """`value` and its `origin`: observed at anchors, interpolated between them by constant growth, and after the last one extrapolated
    as the last anchor times `scale` over the scale there (null without a scale, or where the scale at the anchor is 0 or null).
    Before the first anchor value and origin are null."""
    own = Window.partitionBy(*part).orderBy(order)
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(known).isNotNull(), F.col(order))
    marked = spine.withColumns({
        "_v0": F.last(known, True).over(back), "_t0": F.last(at, True).over(back),
        "_v1": F.first(known, True).over(ahead), "_t1": F.first(at, True).over(ahead),
        "_s0": F.last(F.when(F.col(known).isNotNull(), F.struct(F.col(scale or order).alias("s"))), True).over(back),
    })
    between = F.col("_v0") * F.pow(F.col("_v1") / F.col("_v0"), (F.col(order) - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    here, inside = F.col("_t0") == F.col("_t1"), F.col("_v0").isNotNull() & F.col("_v1").isNotNull()
    beyond = F.lit(None).cast("double") if scale is None else F.when(F.col("_v1").isNull(), F.col("_v0") * F.try_divide(F.col(scale), F.col("_s0.s")))
    value = F.when(here, F.col(known)).when(inside, between).otherwise(beyond)
    origin = F.when(here, "observed").when(inside, "interpolated").when(beyond.isNotNull(), "extrapolated")
    return marked.withColumns({"value": value, "origin": origin}).drop("_v0", "_t0", "_v1", "_t1", "_s0")


def period_sums(df: DataFrame, part: list[str], order: str, col: str, periods: list[tuple[int, int]]) -> DataFrame:
    """Sums strictly after a period's start up to its end. Periods are a short list."""
    table = df.sparkSession.createDataFrame(periods, "t0 int, t1 int")
    inside = (F.col(order) > F.col("t0")) & (F.col(order) <= F.col("t1"))
    return df.join(F.broadcast(table), inside).groupBy(*part, "t0", "t1").agg(F.sum(col).alias("value"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def quantile_row(df: DataFrame, part: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Per group, the least value at which the cumulative weight share reaches q; weights of a value are summed first."""
    own = Window.partitionBy(*part)
    sums = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*part, value).agg(F.sum(weight).alias("_w"))
    share = sums.withColumn("_s", F.sum("_w").over(own.orderBy(value)) / F.sum("_w").over(own))
    return share.where(F.col("_s") >= q).groupBy(*part).agg(F.min(value).alias(value))


def cumulative_counts(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Rows per step of `order` and up to it; counts come before the window."""
    counts = df.where(F.col(order).isNotNull()).groupBy(*part, order).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*part).orderBy(order)))


def latest_known(df: DataFrame, part: list[str], order: str, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(*part).agg(F.max(order).alias(order), F.max_by(col, order).alias(col))


def running_group(df: DataFrame, order: list[str], starts: Column, out: str) -> DataFrame:
    """Number of group starts up to each row in a global order, in two passes: starts per range of the order, then inside.

    The ranges are written once, so that a lost task can't draw them anew; only one row per range meets in one place.
    """
    ranges = stored(df.withColumn("_start", F.coalesce(starts, F.lit(False)).cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.sum("_start").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inside = F.sum("_start").over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + inside).drop("_start", "_range", "_before")
