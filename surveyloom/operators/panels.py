"""Labelled series, densities, cohorts, tract indicators, group panels, value chains and influence functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .estimate import weighted_median
from .quantiles import beside, quantiles

SERIES = "ano int, valor double, valor_min double, valor_max double, tipo_fonte string, recorte string, nota string"


def labelled_series(parts: list[tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """Observations of several sources in one series: each part's ano and valor (or valor_min, valor_max) with its kind, area and note."""
    def one(df, kind, area, note):
        have = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("valor", "valor_min", "valor_max")]
        return df.select(F.col("ano").cast("int").alias("ano"), *have, F.lit(kind).alias("tipo_fonte"), F.lit(area).alias("recorte"), F.lit(note).cast("string").alias("nota"))

    return reduce(DataFrame.unionByName, [one(*p) for p in parts])


def density_bounds(people: Column, area: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """People per area, and its bounds from the area's interval; null where an area is zero or less."""
    return tuple(F.when(a > 0, people / a) for a in (area, high, low))


def cohorts(df: DataFrame, group: list[str], period: str, weight: str, years: dict[str, float | None]) -> DataFrame:
    """Arrivals by period: total, per year of the period (null for an open period) and percent of the group's total."""
    length = F.create_map(*[x for k, v in years.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    sums = df.where(F.col(period).isNotNull()).groupBy(*group, period).agg(F.sum(weight).alias("valor"))
    total = F.sum("valor").over(Window.partitionBy(*group))
    return sums.withColumns({"por_ano": F.col("valor") / F.try_element_at(length, F.col(period)), "pct": 100 * F.col("valor") / total})


def indicator_rows(df: DataFrame, group: list[str], weight: str, shares: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """Long extracts: group, indicator, value: weighted percentages of flags (unknown left out) and weighted means."""
    w = F.col(weight)

    def ratio(x: Column, scale: float) -> Column:
        return scale * F.sum(w * x) / F.sum(F.when(x.isNotNull(), w))

    found = [F.struct(F.lit(k).alias("indicador"), ratio(x.cast("double"), 100.0).alias("valor")) for k, x in shares.items()]
    found += [F.struct(F.lit(k).alias("indicador"), ratio(x.cast("double"), 1.0).alias("valor")) for k, x in means.items()]
    return df.groupBy(*group).agg(F.array(*found).alias("_i")).select(*group, F.explode("_i").alias("_i")).select(*group, "_i.indicador", "_i.valor")


def majority(df: DataFrame, unit: list[str], member: str, size: Column) -> DataFrame:
    """The member that holds most of each unit (ties: the smallest name) and its share in percent."""
    parts = df.groupBy(*unit, member).agg(F.sum(size).alias("_a"))
    out = parts.groupBy(*unit).agg(F.min(F.struct(-F.col("_a"), F.col(member))).alias("_m"), F.sum("_a").alias("_t"))
    return out.select(*unit, F.col(f"_m.{member}").alias(member), (-100 * F.col("_m.col1") / F.col("_t")).alias("pct"))


def ordered_types(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def group_panel(units: DataFrame, group: str, wave: str, weight: str, indicators: list[str]) -> DataFrame:
    """By group and wave: units, weight, each indicator's weighted mean and plain median, and the weight's change since the first wave."""
    w = F.col(weight)
    facts = [F.count("*").alias("n"), F.sum(w).alias("peso")]
    for c in indicators:
        facts.append((F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c))
    panel = units.groupBy(group, wave).agg(*facts)
    for c in indicators:
        panel = beside(panel, [group, wave], quantiles(units, [group, wave], c, {f"{c}_mediana": 0.5}))
    first = F.first("peso").over(Window.partitionBy(group).orderBy(wave))  # a row per wave
    return panel.withColumn("var_pct", 100 * (F.col("peso") / first - 1))


def wide_profile(long: DataFrame, row: str, column: str, values: list, fields: list[str]) -> DataFrame:
    """Indicators as rows, (unit, year) as columns, each with its fields: <column>_<field>."""
    out = long.groupBy(row).pivot(column, values).agg(*[F.max(f).alias(f) for f in fields])
    return out


def value_chain(cells: DataFrame, group: list[str], chain: list[str], members: str, share: str, se: str) -> DataFrame:
    """Sum of the shares of a chain's links with its error in quadrature; a fused cell counts only if all its members are
    links. `missing` lists links that no counted cell covers."""
    links = F.array(*[F.lit(x) for x in sorted(chain)])
    inside = F.forall(members, lambda m: F.array_contains(links, m))
    sums = cells.withColumn("_in", inside).groupBy(*group).agg(
        F.sum(F.when(F.col("_in"), F.col(share))).alias("valor"), F.sqrt(F.sum(F.when(F.col("_in"), F.col(se) * F.col(se)))).alias("ep"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_in"), F.col(members))))).alias("_seen"),
    )
    return sums.withColumn("missing", F.array_join(F.array_sort(F.array_except(links, F.col("_seen"))), "+")).drop("_seen")


def reclassify(df: DataFrame, tier: str, share: str, significant: Column, least: float, up: str) -> DataFrame:
    """Units with a sector share of `least` or more become `up`, unless their own tier rests on a significant exposure."""
    return df.withColumn("classe", F.when(significant, F.col(tier)).when(F.col(share) >= least, F.lit(up)).otherwise(F.col(tier)))


def influence(df: DataFrame, value: str, weight: str, q: float = 0.5) -> DataFrame:
    """Recentred influence of a quantile: weighted quantile, effective n, Silverman bandwidth, Gaussian density there.

    The facts are single rows of aggregates, joined back to all rows; rows without a value or weight get null.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    known = df.where(v.isNotNull() & w.isNotNull())
    facts = known.agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), (F.sum(w * v) / F.sum(w)).alias("_m"))
    spread = known.crossJoin(F.broadcast(facts)).agg(  # one row
        F.max("_w").alias("_w"), F.max(F.col("_w") * F.col("_w") / F.col("_ww")).alias("_n"), F.sqrt(F.sum(w * F.pow(v - F.col("_m"), 2)) / F.max("_w")).alias("_s")
    )
    at = weighted_median(known, [], weight, value, q).select(F.col("value").cast("double").alias("_q"))
    shape = spread.crossJoin(at).withColumn("_h", 1.06 * F.col("_s") * F.pow("_n", F.lit(-0.2)))
    kernel = F.exp(-0.5 * F.pow((v - F.col("_q")) / F.col("_h"), 2)) / (F.col("_h") * F.sqrt(2 * F.pi()))
    density = known.crossJoin(F.broadcast(shape)).agg((F.sum(w * kernel) / F.sum(w)).alias("_d"))
    both = df.crossJoin(F.broadcast(shape.crossJoin(density)))
    rif = F.col("_q") + (F.lit(q) - (v <= F.col("_q")).cast("double")) / F.greatest("_d", F.lit(1e-12))
    return both.withColumn("rif", F.when(w.isNotNull(), rif)).select(*df.columns, "rif")


def report_cells(value: Column, digits: int, mark: Column | None = None) -> Column:
    """A number as a report prints it: '1.234,5' with its mark, a dash where there is none."""
    text = F.translate(F.format_number(value, digits), ",.", ".,")
    return F.coalesce(F.concat(text, mark) if mark is not None else text, F.lit("—"))


def precision_mark(kind: Column) -> Column:
    return F.when(kind == "cautela", "*").when(kind == "baixa", "**").otherwise("")


def interval(value: Column, se: Column) -> tuple[Column, Column]:
    """95 % interval, not below zero."""
    return F.greatest(F.lit(0.0), value - 1.96 * se), value + 1.96 * se


def within_tolerance(value: Column, official: Column, percent: float) -> tuple[Column, Column]:
    """Deviation in percent of an official total and whether it is within the tolerance; null without a total."""
    off = F.when(official > 0, 100 * (value - official) / official)
    return off, F.abs(off) <= percent

