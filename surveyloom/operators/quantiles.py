"""Exact quantiles of many groups at once, weighted or not, by refining ranges of values.

Every quantile is a target: the first value at which the weight so far reaches a bound. A range that holds it is cut into
`PARTS` equal bins, weights are summed by bin (per task before they are shuffled), and the bin that reaches the bound is the
next range, from its least to its largest value; a target is found when both are equal. Only sums by bin are ever brought
together, so no task gets the values of a group, and several targets of a group share a pass. The values are compared as doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored

PARTS = 256
#: Ranges that are broadcast at most (about 10 MB); more are joined by a shuffle.
BROADCAST = 100_000


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of columns of two aliases."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def bin_of() -> Column:
    """The bin of a value in [_lo, _hi]; halves, so that the difference of far apart doubles stays finite."""
    share = (F.col("_y") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def first_reaching(rows: DataFrame, cell: list[str], targets: DataFrame) -> DataFrame:
    """(cell, i, value): the first value at which the weight so far is `_t` or more. rows: cell, _y double, _w; targets: cell, i, _t, _lo, _hi, and _base or not.

    _lo and _hi: a range that holds the target's value, with `_base` of weight below it (none if not given). Targets are few a cell.
    """
    base = F.col("_base") if "_base" in targets.columns else F.lit(0.0).alias("_base")
    targets = stored(targets.select(*cell, "i", "_t", base, "_lo", "_hi"))
    found = []
    while True:
        found.append(targets.where("_lo = _hi").select(*cell, "i", F.col("_lo").alias("value")))
        open_ = targets.where("_lo < _hi")
        n = open_.count()
        if not n:
            break
        ranges = open_.select(*cell, "_lo", "_hi").distinct()
        inside = (F.col("v._y") >= F.col("r._lo")) & (F.col("v._y") <= F.col("r._hi"))
        condition = _same("v", "r", cell) & inside if cell else inside
        held = rows.alias("v").join((F.broadcast(ranges) if n <= BROADCAST else ranges).alias("r"), condition).select(*[f"v.{c}" for c in cell], "_lo", "_hi", "_y", "_w")
        bins = held.groupBy(*cell, "_lo", "_hi", bin_of().alias("_b")).agg(F.sum("_w").alias("_s"), F.min("_y").alias("_from"), F.max("_y").alias("_to"))
        own = Window.partitionBy(*cell, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # PARTS rows at most
        running = bins.withColumn("_c", F.sum("_s").over(own)).withColumn("_last", F.lead("_b").over(Window.partitionBy(*cell, "_lo", "_hi").orderBy("_b")).isNull())
        both = open_.alias("t").join(running.alias("s"), _same("t", "s", [*cell, "_lo", "_hi"]))
        # Sums of doubles may end short of a bound that is the whole weight: the last bin takes it then.
        reached = both.where((F.col("t._base") + F.col("s._c") >= F.col("t._t")) | F.col("s._last"))
        step = F.min(F.struct("s._b", "s._from", "s._to", (F.col("t._base") + F.col("s._c") - F.col("s._s")).alias("_base"), "t._t")).alias("_m")
        key = [F.col(f"t.{c}").alias(c) for c in cell]
        targets = stored(reached.groupBy(*key, F.col("t.i").alias("i")).agg(step).select(
            *cell, "i", F.col("_m._t").alias("_t"), F.col("_m._base").alias("_base"), F.col("_m._from").alias("_lo"), F.col("_m._to").alias("_hi"),
        ))
    return reduce(DataFrame.unionByName, found)


def bounded(value: Column) -> Column:
    """The value as a double; null for NaN, the largest doubles for infinite ones."""
    number, edge = value.cast("double"), F.lit(1.7976931348623157e308)
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.least(number, edge), -edge))


def _rows(df: DataFrame, cell: list[str], value: Column, weight: Column) -> DataFrame:
    return stored(df.select(*cell, bounded(value).alias("_y"), weight.alias("_w")).where("_y is not null"))


def _spread(found: DataFrame, cell: list[str], names: list[str]) -> DataFrame:
    """A column for each i."""
    return found.groupBy(*cell).agg(*[F.max(F.when(F.col("i") == k, F.col("value"))).alias(n) for k, n in enumerate(names)])


def quantiles(df: DataFrame, cell: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """cell and a column per name of `shares`: the value at that share of the rows, between neighbours by interpolation.

    Nulls and NaN don't count; infinite values count as the largest doubles; a null cell is a cell; cells without values are left out.
    """
    rows = _rows(df, cell, F.col(value) if isinstance(value, str) else value, F.lit(1))
    facts = rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).where("_n > 0")
    # Rank floor((n - 1) q) and the rank after it, if the share lies between both; in doubles, as other engines do.
    places = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares.values()]
    ranks = [F.struct(F.lit(2 * k + up).alias("i"), (f(p) + 1).cast("double").alias("_t")) for k, p in enumerate(places) for up, f in ((0, F.floor), (1, F.ceil))]
    targets = facts.select(*cell, "_lo", "_hi", F.explode(F.array(*ranks)).alias("_r")).select(*cell, F.col("_r.i").alias("i"), F.col("_r._t").alias("_t"), "_lo", "_hi")
    names = [f"_{side}{k}" for k in range(len(shares)) for side in "ab"]
    both = _spread(first_reaching(rows, cell, targets), cell, names)
    counted = both.alias("v").join(facts.select(*cell, "_n").alias("f"), _same("v", "f", cell)).select("v.*", "f._n") if cell else both.crossJoin(facts.select("_n"))  # a row each
    between = [(F.col(f"_a{k}") + (p - F.floor(p)) * (F.col(f"_b{k}") - F.col(f"_a{k}"))).alias(n) for k, (n, p) in enumerate(zip(shares, places))]
    return counted.select(*cell, *between)


def weighted_quantiles(df: DataFrame, cell: list[str], weight: str | Column, value: str | Column, shares: dict[str, float]) -> DataFrame:
    """cell and a column per name of `shares`: the first value whose cumulative weight reaches that share of the cell's weight (to nine digits).

    Cells whose weight is zero or less are left out, nulls and NaN don't count.
    """
    rows = _rows(df, cell, F.col(value) if isinstance(value, str) else value, (F.col(weight) if isinstance(weight, str) else weight).cast("double"))
    facts = rows.where("_w is not null").groupBy(*cell).agg(F.sum("_w").alias("_whole"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).where("_whole > 0")
    bounds = [F.struct(F.lit(k).alias("i"), (F.lit(float(q)) * F.col("_whole") - 1e-9 * F.col("_whole")).alias("_t")) for k, q in enumerate(shares.values())]
    targets = facts.select(*cell, "_lo", "_hi", F.explode(F.array(*bounds)).alias("_r")).select(*cell, F.col("_r.i").alias("i"), F.col("_r._t").alias("_t"), "_lo", "_hi")
    return _spread(first_reaching(rows, cell, targets), cell, list(shares))


def beside(facts: DataFrame, cell: list[str], found: DataFrame) -> DataFrame:
    """Rows of `facts` with the columns of `found` for their cell, null where it has none; null cells meet."""
    more = [c for c in found.columns if c not in cell]
    return facts.alias("v").join(found.alias("f"), _same("v", "f", cell), "left").select("v.*", *[f"f.{c}" for c in more])
