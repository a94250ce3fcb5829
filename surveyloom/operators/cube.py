"""The estimates cube: waves x geographies x universes x up to two dimensions, suppressed, with standard errors, as one long table.

Records are spread over geographies once and stored; each table of the cube is a grouping of them. Which cells are shown
follows from pattern tables (their size doesn't grow with the records), and only shown cells meet replicate weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import recode as R
from ..sources.storage import stored
from . import disclosure as D
from . import estimate as E

# Universes from the widest to the most restricted.
UNIVERSE_ORDER = [
    "pessoas", "pessoas_5mais", "pessoas_10mais", "pessoas_25mais", "com_rendimento", "ocupados", "chegados", "migrantes_5anos", "migrantes_internos", "domicilios",
]
KEYS = ["censo", "geografia", "universo", "estatistica", "variavel", "dim1", "cat1", "dim2", "cat2"]
OPEN_SIZE = 30
REST = "\x00rest"


@dataclass
class Dimension:
    """A category column, the universe it is asked of, and its categories in order (None: an open list)."""

    column: str
    universe: str
    categories: list[str] | None
    ordinal: bool = False
    partners: dict[str, str] = field(default_factory=dict)


@dataclass
class Spec:
    """What a cube holds. Geographies: name to (records inside, records of the complement that differencing would show, or None)."""

    household: str
    weight: str
    geographies: dict[str, tuple[Column, Column | None]]
    universes: dict[str, Column]
    dimensions: dict[str, Dimension]
    crossings: list[tuple[str, str]]
    means: list[tuple[str, str, str | None]]
    wave: str = "censo"


def crossing_universe(dim1: Dimension, dim2: Dimension | None) -> str:
    """The more restricted of two dimensions' universes; persons and dwellings can't be crossed."""
    if dim2 is None:
        return dim1.universe
    if (dim1.universe == "domicilios") != (dim2.universe == "domicilios"):
        raise ValueError(f"crossing of different levels: {dim1.column} x {dim2.column}")
    return max(dim1.universe, dim2.universe, key=UNIVERSE_ORDER.index)


def slices(micro: DataFrame, spec: Spec) -> DataFrame:
    """A row per record and geography that holds it (rest false) or whose complement does (rest true); universes as u_<name>."""
    parts = []
    for name, (inside, rest) in spec.geographies.items():
        parts.append(F.when(F.coalesce(inside, F.lit(False)), F.struct(F.lit(name).alias("g"), F.lit(False).alias("r"))))
        if rest is not None:
            parts.append(F.when(F.coalesce(rest, F.lit(False)), F.struct(F.lit(name).alias("g"), F.lit(True).alias("r"))))
    flags = [F.coalesce(c, F.lit(False)).alias(f"u_{u}") for u, c in spec.universes.items()]
    columns = {d.column for d in spec.dimensions.values()} | {m for m, _, _ in spec.means} | {spec.wave, spec.household, spec.weight}
    rows = micro.select(*sorted(columns), *flags, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_g"))
    return rows.select("*", F.col("_g.g").alias("geografia"), F.col("_g.r").alias("rest")).drop("_g").withColumnRenamed(spec.wave, "censo")


def _ranked(rows: DataFrame, group: list[str], column: str) -> tuple[DataFrame, list[str], DataFrame]:
    """An open list by rank: rows with the rank of their category in their group as category, ranks in order, and rank to name.

    The largest OPEN_SIZE categories have ranks; the others, if two or more, are one category, REST.
    """
    counts = rows.where(~F.col("rest") & F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*group)
    ranks = counts.withColumns({"_r": F.row_number().over(own.orderBy(F.desc("_n"), column)), "_k": F.count("*").over(own)})
    top = ranks.where((F.col("_r") <= OPEN_SIZE) | (F.col("_k") == OPEN_SIZE + 1)).select(*group, column, F.format_string("r%02d", "_r").alias("_rank"))
    out = rows.join(top, [*group, column], "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_rank", F.lit(REST))))
    return out.drop("_rank"), [*(f"r{i:02d}" for i in range(1, OPEN_SIZE + 2)), REST], top.withColumnRenamed(column, "_name")


def shown_cells(rows: DataFrame, group: list[str], dim: Dimension, household: str) -> DataFrame:
    """group, cat (label), members (the categories it stands for), n, n_dom, n_suppressed."""
    known = rows.where(F.col(dim.column).isNotNull())
    if dim.categories is not None:
        table = D.patterns(known, group, dim.column, household, dim.categories, F.col("rest"))
        return D.suppress(table, group, dim.categories, F.col("censo"), dim.ordinal, dim.partners).withColumnRenamed("label", "cat")
    ranked, order, names = _ranked(known, group, dim.column)
    cells = D.suppress(D.patterns(ranked, group, dim.column, household, order, F.col("rest")), group, order, F.col("censo"), pooled=REST)
    columns = [*group, "cat", "members", "n", "n_dom", "n_suppressed"]
    single = (F.size("members") == 1) & (F.col("members")[0] != REST)
    one = cells.where(single).withColumn("_rank", F.col("members")[0]).join(names, [*group, "_rank"])
    one = one.withColumns({"cat": F.col("_name"), "members": F.array("_name")})
    # The complement: categories that are pooled or fused, whatever their number.
    fused = cells.where(~single).withColumns({"cat": F.lit(D.FUSED), "members": F.lit(None).cast("array<string>")})
    return one.select(columns).unionByName(fused.select(columns))


def labelled(rows: DataFrame, cells: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """rows of shown cells with their label as column `out`; a bare 'outros' takes what no other cell of its group names."""
    named = cells.where(F.col("members").isNotNull()).select(*group, F.col("cat").alias(out), F.explode("members").alias(column))
    bare = cells.where(F.col("members").isNull()).select(*group, F.col("cat").alias("_bare"))
    joined = rows.where(F.col(column).isNotNull()).join(named, [*group, column], "left").join(bare, group, "left")
    return joined.withColumn(out, F.coalesce(out, "_bare")).where(F.col(out).isNotNull()).drop("_bare")


def _finished(df: DataFrame) -> DataFrame:
    cv = F.when(F.col("valor") > 0, 100 * F.col("ep") / F.col("valor"))
    return df.select(
        *KEYS, "valor", "ep", F.round(cv, 4).alias("cv"), F.greatest(F.lit(0.0), F.col("valor") - 1.96 * F.col("ep")).alias("ic_inf"), (F.col("valor") + 1.96 * F.col("ep")).alias("ic_sup"),
        R.precision_class(cv).alias("classe_precisao"), R.sample_band(F.col("n")).alias("n_faixa"), R.sample_band(F.col("n_dom")).alias("n_dom_faixa"),
    )


def _rows(est: DataFrame, statistic: str, universe: str, dim1: str | None, dim2: str | None, value: Column, se: Column, variable: str | None = None) -> DataFrame:
    def name(x):
        return F.lit(x).cast("string")

    cat1 = F.col("cat1") if dim1 and "cat1" in est.columns else name(None)
    cat2 = F.col("cat2") if dim2 and "cat2" in est.columns else name(None)
    return est.select(
        "censo", "geografia", name(universe).alias("universo"), name(statistic).alias("estatistica"), name(variable).alias("variavel"), name(dim1).alias("dim1"), cat1.alias("cat1"),
        name(dim2).alias("dim2"), cat2.alias("cat2"), value.cast("double").alias("valor"), se.cast("double").alias("ep"), "n", "n_dom",
    )


def build(micro: DataFrame, weights: DataFrame, spec: Spec) -> DataFrame:
    """The cube: KEYS, valor, ep, cv, 95 % interval, precision class and bands of persons and households.

    Sums of all tables are asked for first and made in one pass, where a household meets its draws once.
    """
    h, w = spec.household, spec.weight
    sliced, weights = stored(slices(micro, spec)), stored(weights)  # read by every table of the cube
    base_group = ["censo", "geografia"]
    cell = ["_t", *base_group, "cat1", "cat2"]
    asked, later = [], []

    def ask(rows: DataFrame, group: list[str], x: Column, d: Column | None = None) -> int:
        """The number of a table of sums: its rows are summed by `group`."""
        names = [F.col(c) if c in group else F.lit(None).cast("string").alias(c) for c in ("cat1", "cat2")]
        asked.append(rows.select(F.lit(len(asked)).alias("_t"), *base_group, *names, h, x.cast("double").alias("_x"), (F.lit(0.0) if d is None else d.cast("double")).alias("_d")))
        return len(asked) - 1

    def count_rows(of, counts, group, universe, dim1, dim2):
        later.append(lambda sums: _rows(
            E.with_se(sums(of, group), group, True).join(counts, group), "contagem", universe, dim1, dim2, R.round_to(F.col("value")), F.round("se", 1)
        ))

    bases, whole = {}, {}
    for u in spec.universes:
        inside = sliced.where(F.col(f"u_{u}"))
        size = inside.groupBy(*base_group).agg(
            F.count_if(~F.col("rest")).alias("n"), F.countDistinct(F.when(~F.col("rest"), F.col(h))).alias("n_dom"),
            F.count_if("rest").alias("rest_n"), F.countDistinct(F.when(F.col("rest"), F.col(h))).alias("rest_dom"),
        )
        good = D.differencing(size, F.col("censo")).where(D.meets(F.col("censo"), F.col("n"), F.col("n_dom")) & F.col("safe"))
        bases[u] = stored(good.select(*base_group, "n", "n_dom"))
        own = inside.where("not rest").join(bases[u].select(base_group), base_group)
        whole[u] = ask(own, base_group, F.col(w))
        count_rows(whole[u], bases[u], base_group, u, None, None)

    def emit(rows: DataFrame, cells: DataFrame, group: list[str], base: int, universe: str, dim1: str, dim2: str | None) -> None:
        """Counts and percentages of shown cells. rows: records of the base (rest left out) with their labels; `group` names the base, whose sums are `base`."""
        own = "cat2" if dim2 else "cat1"
        named = labelled(rows, cells, group, spec.dimensions[dim2 or dim1].column, own)
        counts = cells.select(*group, F.col("cat").alias(own), "n", "n_dom")
        each = [*group, own]
        top = ask(named, each, F.col(w))
        count_rows(top, counts, each, universe, dim1, dim2)

        def percent(sums):
            # The base's households count against each cell, whether they are in it or not.
            bottom = sums(base, group).select(*group, "b", F.col("_x").alias("_d")).where("_d is not null")
            part = sums(top, each).select(*each, "b", "_x")
            both = bottom.join(counts.select(each), group).join(part, [*each, "b"], "left")
            pct = both.groupBy(*each).agg(
                F.max(F.when(F.col("b") < 0, R.percent(F.col("_x"), F.col("_d"), 2))).alias("value"),
                F.stddev_samp(F.when(F.col("b") >= 0, 100 * F.coalesce("_x", F.lit(0.0)) / F.col("_d"))).alias("se"),
            )
            return _rows(pct.join(counts, each), "proporcao", universe, dim1, dim2, F.col("value"), F.round("se", 2))

        later.append(percent)

    shown = {}
    for name, dim in spec.dimensions.items():
        rows = sliced.where(F.col(f"u_{dim.universe}")).join(bases[dim.universe].select(base_group), base_group)
        shown[name] = stored(shown_cells(rows, base_group, dim, h))
        emit(rows.where("not rest"), shown[name], base_group, whole[dim.universe], dim.universe, name, None)
    for name1, name2 in spec.crossings:
        one, two = spec.dimensions[name1], spec.dimensions[name2]
        universe = crossing_universe(one, two)
        rows = sliced.where(F.col(f"u_{universe}")).join(bases[universe].select(base_group), base_group)
        first = shown[name1] if one.universe == universe else stored(shown_cells(rows, base_group, one, h))
        rows = stored(labelled(rows, first, base_group, one.column, "cat1"))
        group = [*base_group, "cat1"]
        cells = stored(shown_cells(rows, group, two, h))
        own = rows.where("not rest")
        totals = ask(own, group, F.col(w))
        count_rows(totals, first.select(*base_group, F.col("cat").alias("cat1"), "n", "n_dom"), group, universe, name1, None)
        emit(own, cells, group, totals, universe, name1, name2)
    medians = []
    for variable, universe, name in spec.means:
        rows = sliced.where(F.col(f"u_{universe}") & F.col(variable).isNotNull()).join(bases[universe].select(base_group), base_group)
        group = base_group
        if name is None:
            counts = E.sample_counts(rows.where("not rest"), base_group, h)
            rest = E.sample_counts(rows.where("rest"), base_group, h).withColumnsRenamed({"n": "rest_n", "n_dom": "rest_dom"})
            counts = counts.join(rest, base_group, "left").fillna(0, ["rest_n", "rest_dom"])
            counts = D.differencing(counts, F.col("censo")).where(D.meets(F.col("censo"), F.col("n"), F.col("n_dom")) & F.col("safe"))
            own = rows.where("not rest")
        else:
            dim = spec.dimensions[name]
            cells = stored(shown_cells(rows, base_group, dim, h))
            group, own = [*base_group, "cat1"], labelled(rows.where("not rest"), cells, base_group, dim.column, "cat1")
            counts = cells.select(*base_group, F.col("cat").alias("cat1"), "n", "n_dom")
        mean = ask(own, group, F.col(w) * F.col(variable), F.col(w))
        later.append(lambda sums, mean=mean, group=group, counts=counts, universe=universe, name=name, variable=variable: _rows(
            E.with_se(sums(mean, group), group).join(counts, group), "media", universe, name, None, F.round("value", 2), F.round("se", 2), variable
        ))
        if variable.startswith("renda"):
            mid = E.median_with_se(own, weights, group, h, w, variable).join(counts, group)
            medians.append(_rows(mid, "mediana", universe, name, None, F.round("value", 2), F.round("se", 2), variable))
    replicates = stored(E.replicate_sums(reduce(DataFrame.unionByName, asked), weights, cell, h))

    def sums(table: int, group: list[str]) -> DataFrame:
        return replicates.where(F.col("_t") == table).select(*group, "b", "_x", "_d")

    return distinct_margins(_finished(reduce(DataFrame.unionByName, [make(sums) for make in later] + medians)))


def distinct_margins(cube: DataFrame) -> DataFrame:
    """One row per key: a margin that several tables of the cube hold is the same row each time."""
    return cube.dropDuplicates(KEYS)


def precision_shares(cube: DataFrame, by: list[str]) -> DataFrame:
    """Rows, percent of each precision class, and the median CV."""
    classes = ("boa", "cautela", "baixa", "sem_estimativa")
    share = [F.round(100 * F.count_if(F.col("classe_precisao") == c) / F.count("*"), 4).alias(c) for c in classes]
    return cube.groupBy(*by).agg(F.count("*").alias("linhas"), *share, F.round(F.median("cv"), 4).alias("cv_mediano"))
