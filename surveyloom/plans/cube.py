"""The estimates cube, its parts, and the disclosure gate over published tables."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import cube as C
from ..operators import disclosure as D
from ..operators import estimate as E
from ..sources.storage import new_path, stored
from .estimation import _BOOT, weights
from .fixtures import WITH, persons
from .registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def spec() -> C.Spec:
    c = F.col
    return C.Spec(
        household="controle", weight="peso",
        geographies={
            "sede": ((c("ap") < 5) & (c("situacao") == "urbana"), (c("ap") < 5) & ~c("situacao").eqNullSafe("urbana")),
            "municipio": (c("ap") < 5, None), "estado": (F.lit(True), None),
        },
        universes={"pessoas": F.lit(True), "pessoas_10mais": c("idade") >= 10, "com_rendimento": c("renda") > 0},
        dimensions={
            "segmento": C.Dimension("segmento", "pessoas", SEGMENTS), "status": C.Dimension("status", "pessoas", ["F", "O", "P"]),
            "instrucao": C.Dimension("raca_cod", "pessoas_10mais", [str(i) for i in range(7)], ordinal=True),
            "renda_sexo": C.Dimension("sexo_cod", "com_rendimento", ["0", "1", "2"]), "origem": C.Dimension("mun_origem", "pessoas", None),
        },
        crossings=[("segmento", "status"), ("instrucao", "renda_sexo")],
        means=[("renda", "com_rendimento", None), ("renda", "com_rendimento", "renda_sexo"), ("anos_estudo", "pessoas_10mais", None)],
    )


@query("a16_cube")
def a16(spark, d):
    """The whole cube: counts, percentages, means and medians of all shown cells with their errors."""
    return C.build(persons(spark, d), weights(spark, d), spec())


_GEO = """, geo as (select p.*, unnest(['estado'] || case when ap < 5 then ['municipio'] else [] end || case when ap < 5 and situacao = 'urbana' then ['sede'] else [] end) geografia from persons p),
 rest as (select * from persons where ap < 5 and situacao is distinct from 'urbana')"""
_UNIVERSES = {"pessoas": "true", "pessoas_10mais": "coalesce(idade >= 10, false)", "com_rendimento": "coalesce(renda > 0, false)"}


def _limit(n, h, censo="censo"):
    return f"({n} >= case when {censo} = 2022 then 20 else 10 end and {h} >= case when {censo} = 2022 then 10 else 5 end)"


_BASES = WITH + _BOOT + _GEO + ", un as (" + " union all ".join(f"select '{u}' universo, * from geo where {t}" for u, t in _UNIVERSES.items()) + "), ur as (" + " union all ".join(
    f"select '{u}' universo, censo, count(*) rn, count(distinct controle) rh from rest where {t} group by censo" for u, t in _UNIVERSES.items()
) + f"""), nb as (select universo, geografia, censo, count(*) n, count(distinct controle) n_dom from un group by all),
 good as (select nb.* from nb left join ur on ur.universo = nb.universo and ur.censo = nb.censo and geografia = 'sede' where {_limit('n', 'n_dom', 'nb.censo')} and (coalesce(rn, 0) = 0 or {_limit('rn', 'rh', 'nb.censo')})) """
_SHAPE = "case when n < 5 then '<5' when n <= 9 then '5-9' when n <= 19 then '10-19' when n <= 49 then '20-49' when n <= 99 then '50-99' when n <= 499 then '100-499' else '>=500' end"


@query("a10_universe_totals", _BASES + f""", s as (select universo, geografia, censo, controle, sum(peso) x from un join good using (universo, geografia, censo) group by all),
 p as (select universo, geografia, censo, sum(x) v from s group by all), r as (select universo, geografia, censo, b, sum(x * m) v from s join w using (controle) group by all),
 q as (select universo, geografia, censo, stddev_samp(v) e from r group by all)
 select universo, geografia, censo, round_even(v / 10, 0) * 10 valor, round(e, 1) ep, {_SHAPE} n_faixa from p join q using (universo, geografia, censo) join good using (universo, geografia, censo)""")
def a10(spark, d):
    own = spec()
    own.dimensions, own.crossings, own.means = {}, [], []
    return C.build(persons(spark, d), weights(spark, d), own).select("universo", "geografia", "censo", "valor", "ep", "n_faixa")


@query("a13_crossing_universe", _GEO.join([WITH, ""]) + """, b as (select geografia, censo, sum(peso) total from geo where coalesce(renda > 0, false) group by all)
 select geografia, censo, raca_cod cat1, sexo_cod cat2, 'com_rendimento' universo, count(*) n, sum(peso) valor from geo where coalesce(renda > 0, false) group by all""")
def a13(spark, d):
    """Cells of a crossing count in the more restricted of its dimensions' universes."""
    own = spec()
    universe = C.crossing_universe(own.dimensions["instrucao"], own.dimensions["renda_sexo"])
    rows = C.slices(persons(spark, d), own).where(F.col(f"u_{universe}") & ~F.col("rest"))
    return rows.groupBy("geografia", "censo", F.col("raca_cod").alias("cat1"), F.col("sexo_cod").alias("cat2")).agg(
        F.lit(universe).alias("universo"), F.count("*").alias("n"), F.sum("peso").alias("valor")
    )


@query("a14_means_medians", _BASES + """, t as (select geografia, censo, controle, peso, renda from un join good using (universo, geografia, censo) where universo = 'com_rendimento' and renda is not null),
 s as (select geografia, censo, controle, sum(peso * renda) x, sum(peso) d from t group by all), p as (select geografia, censo, sum(x) / sum(d) v from s group by all),
 r as (select geografia, censo, b, sum(x * m) / sum(d * m) v from s join w using (controle) group by all), q as (select geografia, censo, stddev_samp(v) e from r group by all),
 c as (select geografia, censo, renda, sum(peso) over (partition by geografia, censo order by renda) c, sum(peso) over (partition by geografia, censo) z from t),
 md as (select geografia, censo, min(renda) v from c where c >= 0.5 * z - 1e-9 * z group by all),
 mj as (select geografia, censo, b, renda, sum(peso * m) o from t join w using (controle) where b < 60 group by all),
 mc as (select geografia, censo, b, renda, sum(o) over (partition by geografia, censo, b order by renda) c, sum(o) over (partition by geografia, censo, b) z from mj),
 mr as (select geografia, censo, b, min(renda) v from mc where c >= 0.5 * z - 1e-9 * z group by all), me as (select geografia, censo, stddev_samp(v) e from mr group by all)
 select geografia, censo, 'media' estatistica, round(v, 2) valor, round(e, 2) ep from p join q using (geografia, censo)
 union all select geografia, censo, 'mediana', round(v, 2), round(e, 2) from md join me using (geografia, censo)""")
def a14(spark, d):
    own = spec()
    own.dimensions, own.crossings, own.means = {}, [], [("renda", "com_rendimento", None)]
    out = C.build(persons(spark, d), weights(spark, d), own)
    return out.where("estatistica in ('media', 'mediana')").select("geografia", "censo", "estatistica", "valor", "ep")


@query("a17_distinct_margins", WITH + "select censo, segmento, sum(peso) valor from persons group by all")
def a17(spark, d):
    """Two crossings of one dimension hold its margin twice; one row a key is left."""
    p = persons(spark, d)
    twice = [p.groupBy("censo", "segmento", c).agg(F.sum("peso").alias("x")).groupBy("censo", "segmento").agg(F.sum("x").alias("valor")) for c in ("status", "prioridade")]
    named = [t.select("censo", F.lit("estado").alias("geografia"), F.lit("pessoas").alias("universo"), F.lit("contagem").alias("estatistica"), F.lit(None).cast("string").alias("variavel"),
                      F.lit("segmento").alias("dim1"), F.col("segmento").alias("cat1"), F.lit(None).cast("string").alias("dim2"), F.lit(None).cast("string").alias("cat2"), "valor") for t in twice]
    return C.distinct_margins(named[0].unionByName(named[1])).select("censo", F.col("cat1").alias("segmento"), "valor")


@query("a21_precision_shares", WITH + _BOOT + """, s as (select censo, uf_atual, controle, sum(peso) x from persons group by all), p as (select censo, uf_atual, sum(x) v from s group by all),
 r as (select censo, uf_atual, b, sum(x * m) v from s join w using (controle) group by all), q as (select censo, uf_atual, stddev_samp(v) e from r group by all),
 z as (select censo, case when v > 0 then 100 * e / v end cv from p left join q using (censo, uf_atual)),
 k as (select censo, cv, case when cv is null then 'sem_estimativa' when cv <= 15 then 'boa' when cv <= 30 then 'cautela' else 'baixa' end c from z)
 select censo, count(*) linhas, round(100 * count(*) filter (c = 'boa') / count(*), 4) boa, round(100 * count(*) filter (c = 'cautela') / count(*), 4) cautela,
 round(100 * count(*) filter (c = 'baixa') / count(*), 4) baixa, round(100 * count(*) filter (c = 'sem_estimativa') / count(*), 4) sem_estimativa, round(median(cv), 4) cv_mediano from k group by censo""")
def a21(spark, d):
    est = E.total(persons(spark, d), weights(spark, d), ["censo", "uf_atual"], "controle", "peso")
    cv = F.when(F.col("value") > 0, 100 * F.col("se") / F.col("value"))
    return C.precision_shares(est.select("censo", cv.alias("cv"), R.precision_class(cv).alias("classe_precisao")), ["censo"])


@query("d09_open_list", WITH + f""", k0 as (select censo, mun_origem, count(*) n from persons where mun_origem is not null group by all), k as (select *, row_number() over (partition by censo order by n desc, mun_origem) r from k0)
 select p.censo, case when r <= {C.OPEN_SIZE} then p.mun_origem else 'outros' end cat, count(*) n, count(distinct controle) n_dom from persons p join k on k.censo = p.censo and k.mun_origem = p.mun_origem group by all""")
def d09(spark, d):
    """An open list: the most frequent categories by name, the rest as its complement 'outros'."""
    rows = persons(spark, d).select("censo", "controle", "mun_origem", F.lit(False).alias("rest"))
    return C.shown_cells(rows, ["censo"], C.Dimension("mun_origem", "pessoas", None), "controle").select("censo", "cat", "n", "n_dom")


# A published table with faults of every kind, as rows of the given tables would show them.
_FAULTY = """select censo, 'ap' || ap geografia, 'pessoas' universo, 'contagem' estatistica, case when ap = 7 then 'inventada' else 'status' end dim1,
 case when ap = 8 then 'outros:' || status || '+X' else status end cat1, cast(null as varchar(9)) dim2, cast(null as varchar(9)) cat2,
 case when ap % 10 = 3 then cast(total as double) else cast(floor(total / 10) * 10 as double) end valor, case when ap = 4 then '7' else {band} end n_faixa, {dom} n_dom_faixa,
 case when ap = 5 then null when n >= 40 then 12.5 else 33.0 end cv, case when ap = 6 then 'sem_estimativa' when n >= 40 then 'boa' else 'baixa' end classe_precisao,
 n, n_dom, rest_n, rest_dom, case when ap = 8 then 1 else 2 end present1, 1 present2
 from (select censo, ap, status, count(*) n, count(distinct controle) n_dom, sum(peso) total, count(case when situacao = 'rural' then 1 end) rest_n,
       count(distinct case when situacao = 'rural' then controle end) rest_dom from persons group by censo, ap, status) t"""
_FAULTY = _FAULTY.format(band=_SHAPE, dom=_SHAPE.replace("n <", "n_dom <"))
_TESTS = {
    "R1": (f"not {_limit('n', 'n_dom')}", "n || '/' || n_dom"),
    "R2": ("valor - floor(valor / 10) * 10 > 1e-6", "null"),
    "R3": (f"n_faixa not in {tuple(D.BANDS)} or n_dom_faixa not in {tuple(D.BANDS)}", "n_faixa || '/' || n_dom_faixa"),
    "R6": ("cv is null or classe_precisao = 'sem_estimativa'", "classe_precisao"),
    "R7": (f"rest_n > 0 and not {_limit('rest_n', 'rest_dom')}", "rest_n || '/' || rest_dom"),
    "R8": ("cat1 like 'outros%' and present1 < 2", "cat1"),
}
_FOUND = WITH + f", f as ({_FAULTY}), v as (" + " union all ".join(f"select '{r}' rule, censo, geografia, cat1 from f where {t}" for r, (t, _) in _TESTS.items()) + f"""
 union all select 'R3', censo, geografia, cat1 from f where n_faixa <> {_SHAPE}
 union all select 'R4', censo, geografia, cat1 from f where dim1 = 'inventada' union all select 'R4', censo, geografia, cat1 from f where cat1 like '%+X') """


def _broken(spark, d):
    persons(spark, d).createOrReplaceTempView("persons_seen")
    faulty = spark.sql(_FAULTY.replace("from persons group", "from persons_seen group").replace("varchar(9)", "string"))
    return D.violations(faulty, {"status": ["F", "O", "P"]})


@query("d14_violations", _FOUND + "select rule, censo, geografia, cat1 from v")
def d14(spark, d):
    return _broken(spark, d).select("rule", "censo", "geografia", "cat1")


@query("d14_gate", _FOUND + "select 'R' || i rule, count(v.rule) n_violations, count(v.rule) = 0 passed from range(1, 9) t(i) left join v on v.rule = 'R' || i group by 1")
def d14b(spark, d):
    return D.gate(_broken(spark, d))


for _name, _rule in (("d02_rounding_and_bands", ("R2", "R3")), ("d03_registry", ("R4",)), ("d05_precision_given", ("R6",))):
    query(_name, _FOUND + f"select rule, censo, geografia, cat1 from v where rule in ({', '.join(repr(r) for r in _rule)})")(
        lambda spark, d, r=_rule: d14(spark, d).where(F.col("rule").isin(*r))
    )


@query("d04_forbidden_columns", WITH + "select 'dwellings' tab, 'ap' col, count(ap) n from dwellings union all select 'dwellings', 'controle', count(controle) from dwellings union all select 'dwellings', 'peso', count(peso) from dwellings union all select 'persons', 'ap', count(ap) from persons union all select 'persons', 'controle', count(controle) from persons union all select 'persons', 'peso', count(peso) from persons")
def d04(spark, d):
    """Columns that no published table may have, and how many values each would give away."""
    from .fixtures import dwellings

    tables = {"persons": persons(spark, d), "dwellings": dwellings(spark, d)}
    out = None
    for name, column in D.forbidden_columns(tables):
        one = tables[name].agg(F.lit(name).alias("tab"), F.lit(column).alias("col"), F.count(column).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("d17_export", WITH + "select '2022.1' as version, count(*) as rows, 0::bigint problems from (select distinct censo, segmento from persons)")
def d17(spark, d):
    """A table is exported once its gate passes; the files are stamped and the stamps verified."""
    cells = persons(spark, d).groupBy("censo", "segmento").agg(F.count("*").alias("n"), F.countDistinct("controle").alias("n_dom"), F.sum("peso").alias("x"))
    good = D.threshold(cells).where("publishable")
    none, cv = F.lit(None).cast("string"), F.lit(10.0)
    table = good.select(
        "censo", F.lit("estado").alias("geografia"), F.lit("pessoas").alias("universo"), F.lit("contagem").alias("estatistica"), F.lit("segmento").alias("dim1"), F.col("segmento").alias("cat1"),
        none.alias("dim2"), none.alias("cat2"), R.round_to(F.col("x")).alias("valor"), R.sample_band(F.col("n")).alias("n_faixa"), R.sample_band(F.col("n_dom")).alias("n_dom_faixa"),
        cv.alias("cv"), R.precision_class(cv).alias("classe_precisao"),
    )
    table = stored(table)
    path = new_path(spark)
    manifest = D.export(table, path, D.gate(D.violations(table, {"segmento": SEGMENTS})), "2022.1")
    stamp = stored(D.stamps(spark, path))
    problems = D.verify_stamps(stamp, D.stamps(spark, path)).agg(F.count("*").alias("problems"))
    return manifest.select("version", "rows").crossJoin(problems)  # one row each


@query("d20_forbidden_paths", r"select page_id, url from pages where (regexp_matches(url, '\?') or regexp_matches(url, '#')) and not regexp_matches(url, '/en/')")
def d20(spark, d):
    return D.forbidden_paths(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), "url", [r"\?", "#"], ["/en/"])
