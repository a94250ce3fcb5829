"""Analysis operators over estimates, panels and microdata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import beside, quantiles
from .series import correlation, ranked


def ratio_delta(a: Column, se_a: Column, b: Column, se_b: Column) -> tuple[Column, Column]:
    """Ratio and its delta-method standard error; null for a zero base."""
    ratio = F.try_divide(a, b)
    return ratio, F.abs(ratio) * F.sqrt(F.pow(F.try_divide(se_a, a), 2) + F.pow(F.try_divide(se_b, b), 2))


def difference_delta(a: Column, se_a: Column, b: Column, se_b: Column) -> tuple[Column, Column, Column]:
    """Difference, its standard error, and whether it is beyond 1.96 of them."""
    diff, se = a - b, F.sqrt(se_a * se_a + se_b * se_b)
    return diff, se, F.abs(diff) > 1.96 * se


def did(cube: DataFrame, focus: str, controls: list[str], periods: list[tuple[int, int]]) -> DataFrame:
    """Difference in differences of every indicator. cube: unit, wave, indicator, value, se; missing pairs are left out."""
    pairs = cube.sparkSession.createDataFrame(periods, "w0 int, w1 int")
    start = cube.select("unit", "indicator", F.col("wave").alias("w0"), F.col("value").alias("v0"), F.col("se").alias("s0"))
    end = cube.select("unit", "indicator", F.col("wave").alias("w1"), F.col("value").alias("v1"), F.col("se").alias("s1"))
    moves = start.join(F.broadcast(pairs), "w0").join(end, ["unit", "indicator", "w1"])
    delta, se, _ = difference_delta(F.col("v1"), F.col("s1"), F.col("v0"), F.col("s0"))
    moves = moves.select("unit", "indicator", "w0", "w1", delta.alias("d"), se.alias("s"))
    own = moves.where(F.col("unit") == focus).select("indicator", "w0", "w1", F.col("d").alias("df"), F.col("s").alias("sf"))
    other = moves.where(F.col("unit").isin(controls)).select(F.col("unit").alias("control"), "indicator", "w0", "w1", F.col("d").alias("dc"), F.col("s").alias("sc"))
    diff, se, sure = difference_delta(F.col("df"), F.col("sf"), F.col("dc"), F.col("sc"))
    return own.join(other, ["indicator", "w0", "w1"]).select("indicator", "w0", "w1", "control", diff.alias("did"), se.alias("se"), sure.alias("significant"))


def growth(v0: Column, v1: Column, years: Column) -> Column:
    """Geometric annual rate in percent."""
    return 100 * (F.pow(F.try_divide(v1, v0), 1 / years) - 1)


def elasticity(y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    """d ln y / d ln x; null where either log isn't defined or x didn't move."""
    return F.try_divide(F.ln(F.try_divide(y1, y0)), F.ln(F.try_divide(x1, x0)))


def gradients(df: DataFrame, group: list[str], value: str, axis: str, least: int = 5) -> DataFrame:
    """group, n, slope of the value along the axis and Spearman's rank correlation, over rows that have both; both are null below
    `least` rows or without spread. Ranks of a group are spread over all tasks."""
    known = df.where(F.col(value).isNotNull() & F.col(axis).isNotNull()).select(*group, F.col(value).alias("_v"), F.col(axis).alias("_a"))
    both = ranked(ranked(known, group, "_v", "_rv"), group, "_a", "_ra")
    out = both.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope("_v", "_a").alias("slope"), correlation("_rv", "_ra").alias("spearman"))
    enough = F.col("n") >= least
    return out.withColumns({"slope": F.when(enough, F.col("slope")), "spearman": F.when(enough, F.col("spearman"))})


def inequality(df: DataFrame, group: list[str], value: str, weight: str, least: int = 5) -> DataFrame:
    """Weighted mean, extremes, deciles, CV and P90/P10 of units with a value; groups of fewer than `least` are left out."""
    v = F.col(value)
    known = df.where(v.isNotNull())
    out = known.groupBy(*group).agg(
        F.count("*").alias("n"), (F.sum(v * F.col(weight)) / F.sum(weight)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"),
    )
    deciles = quantiles(known, group, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return beside(out.where(F.col("n") >= least), group, deciles).withColumn("p90_p10", F.try_divide("p90", "p10"))


def exposure_tiers(df: DataFrame, value: str) -> DataFrame:
    """Tiers among positive values: alta from the 90th percentile, media from the 50th, else baixa; none without a value."""
    cuts = quantiles(df.where(F.col(value) > 0), [], value, {"_a": 0.5, "_b": 0.9})
    tier = F.when(~(F.coalesce(value, F.lit(0.0)) > 0), "nenhuma").when(F.col(value) >= F.col("_b"), "alta").when(F.col(value) >= F.col("_a"), "media").otherwise("baixa")
    return df.join(F.broadcast(cuts), how="left").withColumn("tier", tier).drop("_a", "_b")  # one row, none without positive values


def class_breaks(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """One row: the inner quantile breaks of k classes, linearly interpolated, pooled over all rows."""
    cuts = {f"_{i}": i / k for i in range(1, k)}
    return quantiles(df, [], col, cuts).select(F.array(*cuts).alias("breaks"))


OAXACA = (
    "gap double, endowments double, coefficients double, interaction double, pct_explained double, n_a long, n_b long,"
    " terms array<struct<name: string, mean_a: double, mean_b: double, slope_a: double, slope_b: double, endowment: double>>"
)


def oaxaca(df: DataFrame, y: str, xs: list[str], weight: str, group: Column) -> DataFrame:
    """Three-fold split of a weighted mean gap between rows where `group` holds (a) and where it doesn't (b), any list of regressors.

    One row: gap, endowments, coefficients, interaction, percent explained by endowments, rows a side, and a term per regressor.
    Rows with a null in any of the columns, or without weight, are left out. Normal equations need the weighted sums of products
    only, (p + 2)(p + 3) / 2 a group in one aggregate; two rows of sums are solved. Split and slopes are null where a group's
    regressors are collinear or a group is empty.
    """
    names = ["_one", *[f"_x{i}" for i in range(len(xs))], "_y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    values = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    rows = df.select(group.alias("_g"), F.col(weight).cast("double").alias("_w"), *[v.alias(n) for n, v in zip(names, values)]).dropna()
    sums = [F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"_s{i}_{j}") for i, j in pairs]
    gram = rows.where("_w > 0").groupBy("_g").agg(F.count("*").alias("_n"), *sums)  # two rows
    size, labels = len(names), list(xs)

    def fit(row):
        import numpy as np

        full = np.zeros((size, size))
        for i, j in pairs:
            full[i, j] = full[j, i] = row[f"_s{i}_{j}"]
        means = full[0] / full[0, 0]
        spread = full / full[0, 0] - np.outer(means, means)  # moments about the means
        inner, scale = spread[1:-1, 1:-1], np.sqrt(np.clip(np.diag(spread)[1:-1], 0, None))
        steady = bool(np.all(scale > 0)) and np.linalg.matrix_rank(inner / np.outer(scale, scale), tol=1e-9) == len(labels)
        return means, np.linalg.solve(inner, spread[1:-1, -1]) if steady else None

    def split(tables):
        import pandas as pd

        sides = {bool(r["_g"]): r for table in tables for _, r in table.iterrows() if r["_n"]}
        out = dict.fromkeys(("gap", "endowments", "coefficients", "interaction", "pct_explained"))
        out |= {"n_a": int(sides[True]["_n"]) if True in sides else 0, "n_b": int(sides[False]["_n"]) if False in sides else 0, "terms": None}
        if len(sides) == 2:
            (ma, sa), (mb, sb) = fit(sides[True]), fit(sides[False])
            out["gap"] = gap = float(ma[-1] - mb[-1])
            if sa is not None and sb is not None:
                apart = ma[1:-1] - mb[1:-1]
                out["endowments"], out["interaction"] = float(apart @ sb), float(apart @ (sa - sb))
                out["coefficients"] = gap - out["endowments"] - out["interaction"]
                out["pct_explained"] = 100 * out["endowments"] / gap if gap else None
                columns = (labels, ma[1:-1], mb[1:-1], sa, sb, apart * sb)
                fields = ("name", "mean_a", "mean_b", "slope_a", "slope_b", "endowment")
                out["terms"] = [dict(zip(fields, (t[0], *map(float, t[1:])))) for t in zip(*columns)]
        yield pd.DataFrame([out]).astype(object)

    none = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_n"))  # so that a table without rows has an answer too
    return gram.unionByName(none, allowMissingColumns=True).coalesce(1).mapInPandas(split, OAXACA)  # three rows at most


def increasing(breaks: DataFrame, step: float = 1e-6) -> DataFrame:
    """(i, corte): breaks (one row, an array) made strictly increasing: each is the largest of those up to it, plus a step a place."""
    nudged = F.transform("breaks", lambda b, i: b - i * step)
    top = F.transform(F.sequence(F.lit(1), F.size("breaks")), lambda n: F.array_max(F.slice(nudged, F.lit(1), n)) + (n - 1) * step)
    return breaks.select(F.posexplode(top).alias("i", "corte")).withColumn("i", F.col("i") + 1)
