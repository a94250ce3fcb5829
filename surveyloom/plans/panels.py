"""Series, cohorts, panels, chains and report cells seen in the driver's tables."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import analysis as A
from ..operators import disclosure as D
from ..operators import estimate as E
from ..operators import joins as J
from ..operators import panels as P
from .estimation import _BOOT, _GROUP, _MASKS, SHARES, _statuses, weights
from .fixtures import WITH, persons, pixels
from .recoding import TYPED, typed
from .registry import query

c = F.col


@query("x01_population_series", """with y as (select year(o_orderdate)::int ano, count(*)::double n from orders group by 1)
 select ano, n valor, null::double valor_min, null::double valor_max, 'oficial_censo' tipo_fonte, 'municipio' recorte, null::varchar nota from y where ano in (1995, 2000)
 union all select ano, n, null, null, 'estimativa_oficial', 'municipio', 'ancorada no censo anterior' from y where ano not in (1995, 2000)
 union all select ano, null, round(n * 4.76), round(n * 5.5), 'estimativa_propria', 'assentamento', null from y where ano = 1994""")
def x01(spark, d):
    y = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.year("o_orderdate").alias("ano")).agg(F.count("*").alias("valor"))
    bounds = y.where("ano = 1994").select("ano", F.round(c("valor") * 4.76).alias("valor_min"), F.round(c("valor") * 5.5).alias("valor_max"))
    return P.labelled_series([
        (y.where("ano in (1995, 2000)"), "oficial_censo", "municipio", None), (y.where("ano not in (1995, 2000)"), "estimativa_oficial", "municipio", "ancorada no censo anterior"),
        (bounds, "estimativa_propria", "assentamento", None),
    ])


@query("x05_density_bounds", WITH + "select censo, segmento, round(pop / area, 6) d, round(pop / (area * 1.1), 6) d_min, round(pop / (area * 0.9), 6) d_max from (select censo, segmento, sum(peso) pop, count(distinct controle) * 0.09::double area from persons group by all)")
def x05(spark, d):
    s = persons(spark, d).groupBy("censo", "segmento").agg(F.sum("peso").alias("pop"), (F.countDistinct("controle") * 0.09).alias("area"))
    mid, low, high = P.density_bounds(c("pop"), c("area"), c("area") * 0.9, c("area") * 1.1)
    return s.select("censo", "segmento", F.round(mid, 6).alias("d"), F.round(low, 6).alias("d_min"), F.round(high, 6).alias("d_max"))


_PERIODS = {"ate_1994": None, "1995_1998": 4.0, "1999_mais": 2.6}


@query("x06_cohorts", WITH + """, k as (select censo, case when ano <= 1994 then 'ate_1994' when ano <= 1998 then '1995_1998' else '1999_mais' end periodo, sum(peso) valor from persons where idade >= 5 group by all)
 select censo, periodo, valor, round(case periodo when '1995_1998' then valor / 4.0 when '1999_mais' then valor / 2.6 end, 6)::double por_ano, round(100 * valor / sum(valor) over (partition by censo), 6) pct from k""")
def x06(spark, d):
    p = persons(spark, d).where("idade >= 5").withColumn("periodo", R.band(c("ano"), [1994, 1998], list(_PERIODS)))
    return P.cohorts(p, ["censo"], "periodo", "peso", _PERIODS).withColumns({k: F.round(k, 6) for k in ("por_ano", "pct")})


@query("x08_labour_extracts", TYPED + """, t as (select *, case when tipo = 'nao_migrante' then 'nao_migrante' else 'migrante' end grupo from typed where tipo is not null)
 select censo, grupo, 'urbanos' indicador, round(100 * sum(peso) filter (situacao = 'urbana') / sum(peso) filter (situacao is not null), 6) valor from t group by all
 union all select censo, grupo, 'com_60_mais', round(100 * sum(peso) filter (idade >= 60) / sum(peso) filter (idade is not null), 6) from t group by all
 union all select censo, grupo, 'renda_media', round(sum(peso * renda) / sum(peso) filter (renda is not null), 6) from t group by all""")
def x08(spark, d):
    t = typed(spark, d).where("tipo is not null").withColumn("grupo", F.when(c("tipo") == "nao_migrante", "nao_migrante").otherwise("migrante"))
    out = P.indicator_rows(t, ["censo", "grupo"], "peso", {"urbanos": c("situacao") == "urbana", "com_60_mais": c("idade") >= 60}, {"renda_media": c("renda")})
    return out.withColumn("valor", F.round("valor", 6))


@query("x09_tract_indicators", WITH + """, k as (select (row // 10)::int zr, (col // 10)::int zc, case when red > 40 then 'c' when red > 20 then 'b' else 'a' end cls, sum(nir) a, count(*) n from pixels group by all),
 t as (select zr, zc, sum(a) t, sum(n) n from k group by all) select k.zr, k.zc, arg_min(cls, (-a, cls)) cls, round(100 * max(a) / max(t), 6) pct, round(max(t.n) / 100.0::double, 6) densidade from k join t using (zr, zc) group by all""")
def x09(spark, d):
    z = pixels(spark, d).select(F.floor(c("row") / 10).cast("int").alias("zr"), F.floor(c("col") / 10).cast("int").alias("zc"), R.band(c("red"), [20, 40], ["a", "b", "c"]).alias("cls"), "nir")
    own = P.majority(z, ["zr", "zc"], "cls", c("nir"))
    count = z.groupBy("zr", "zc").agg(F.round(F.count("*") / 100.0, 6).alias("densidade"))
    return own.join(count, ["zr", "zc"]).withColumn("pct", F.round("pct", 6))


_UNITS = """with u as (select c_nationkey unit, sum(o_totalprice) v, count(*) n from customer join orders on o_custkey = c_custkey group by 1) """


def units(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.expr("o_custkey = c_custkey"))
    return o.groupBy(c("c_nationkey").alias("unit")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


@query("x11_group_types", _UNITS + "select unit, case when unit = 3 then 'foco' when unit = 7 then 'vizinho' when unit < 10 and v / n > 250000 then 'sul_alta' when unit < 10 then 'sul_baixa' when v / n > 250000 then 'norte_alta' else 'norte_baixa' end tipo from u")
def x11(spark, d):
    high = c("v") / c("n") > 250000
    south = c("unit") < 10
    rules = [(c("unit") == 3, "foco"), (c("unit") == 7, "vizinho"), (south & high, "sul_alta"), (south, "sul_baixa"), (high, "norte_alta")]
    return units(spark, d).select("unit", P.ordered_types(rules, "norte_baixa").alias("tipo"))


@query("x12_group_panel", WITH + """, u as (select censo, uf_atual, segmento grupo, sum(peso) peso, sum(peso * renda) / sum(peso) filter (renda is not null) renda, 100 * sum(peso) filter (idade >= 60) / sum(peso) filter (idade is not null) idosos from persons group by all),
 k as (select grupo, censo, count(*) n, sum(peso) p, sum(peso * renda) / sum(peso) filter (renda is not null) renda, median(renda) rm, sum(peso * idosos) / sum(peso) filter (idosos is not null) idosos, median(idosos) im from u group by all)
 select grupo, censo, n, p peso, round(renda, 4) renda, round(rm, 4) renda_mediana, round(idosos, 4) idosos, round(im, 4) idosos_mediana, round(100 * (p / first(p) over (partition by grupo order by censo) - 1), 4) var_pct from k""")
def x12(spark, d):
    w = c("peso")
    u = persons(spark, d).groupBy("censo", "uf_atual", c("segmento").alias("grupo")).agg(
        F.sum("peso").alias("peso"), (F.sum(w * c("renda")) / F.sum(F.when(c("renda").isNotNull(), w))).alias("renda"),
        (100 * F.sum(F.when(c("idade") >= 60, w)) / F.sum(F.when(c("idade").isNotNull(), w))).alias("idosos"),
    )
    out = P.group_panel(u, "grupo", "censo", "peso", ["renda", "idosos"])
    return out.withColumns({k: F.round(k, 4) for k in ("renda", "renda_mediana", "idosos", "idosos_mediana", "var_pct")})


_WAVES = [1991, 2000, 2010, 2022]


@query("x14_baseline_profile", WITH + _BOOT + """, s as (select segmento, censo, controle, sum(peso) d, coalesce(sum(peso) filter (idade >= 60), 0) x from persons group by all), p as (select segmento, censo, 100 * sum(x) / sum(d) v from s group by all),
 r as (select segmento, censo, b, 100 * sum(x * m) / sum(d * m) v from s join w using (controle) group by all), q as (select segmento, censo, stddev_samp(v) e from r group by all),
 z as (select *, case when v > 0 and 100 * e / v <= 15 then 'boa' when v > 0 and 100 * e / v <= 30 then 'cautela' when v > 0 then 'baixa' else 'sem_estimativa' end k from p join q using (segmento, censo)) select segmento, """ + ", ".join(
    f'round(max(v) filter (censo = {y}), 4) "{y}_valor", round(max(e) filter (censo = {y}), 4) "{y}_ep", max(k) filter (censo = {y}) "{y}_classe"' for y in _WAVES
) + " from z group by segmento")
def x14(spark, d):
    est = E.proportion(persons(spark, d), weights(spark, d), ["segmento", "censo"], "controle", "peso", c("idade") >= 60)
    v, e = 100 * c("value"), 100 * c("se")
    long = est.select("segmento", "censo", F.round(v, 4).alias("valor"), F.round(e, 4).alias("ep"), R.precision_class(F.when(v > 0, 100 * e / v)).alias("classe"))
    return P.wide_profile(long, "segmento", "censo", _WAVES, ["valor", "ep", "classe"])


@query("x16_value_chain", _MASKS + """, k as (select *, n::double / sum(n) over (partition by censo, ap, ano) s, sqrt(n) / sum(n) over (partition by censo, ap, ano) e, string_split(replace(label, 'outros:', ''), '+') l from cells),
 i as (select *, list_has_all(['F', 'P'], l) inside from k)
 select censo, ap, ano, round(sum(s) filter (inside), 6) valor, round(sqrt(sum(e * e) filter (inside)), 6) ep, array_to_string([x for x in ['F', 'P'] if not list_contains(coalesce(flatten(list(l) filter (inside)), []), x)], '+') missing from i group by all""")
def x16(spark, d):
    from pyspark.sql.window import Window

    cells = D.suppress(_statuses(spark, d), _GROUP, SHARES, c("censo"))
    total = F.sum("n").over(Window.partitionBy(*_GROUP))
    out = P.value_chain(cells.withColumns({"s": c("n") / total, "e": F.sqrt("n") / total}), _GROUP, ["F", "P"], "members", "s", "e")
    return out.withColumns({"valor": F.round("valor", 6), "ep": F.round("ep", 6)})


@query("x19_reclassified", _UNITS + """, s as (select c_nationkey unit, count(*) filter (c_mktsegment = 'BUILDING') / count(*)::double share from customer group by 1)
 select unit, round(share, 6) share, n > 600 significante, case when n > 600 then case when v / n > 250000 then 'alta' else 'baixa' end when share >= 0.2 then 'alta' when v / n > 250000 then 'alta' else 'baixa' end classe from u join s using (unit)""")
def x19(spark, d):
    share = spark.read.parquet(f"{d}/customer.parquet").groupBy(c("c_nationkey").alias("unit")).agg((F.count_if(c("c_mktsegment") == "BUILDING") / F.count("*")).alias("share"))
    u = units(spark, d).join(share, "unit").withColumn("tier", F.when(c("v") / c("n") > 250000, "alta").otherwise("baixa"))
    out = P.reclassify(u, "tier", "share", c("n") > 600, 0.2, "alta")
    return out.select("unit", F.round("share", 6).alias("share"), (c("n") > 600).alias("significante"), "classe")


@query("x22_influence", WITH + """, k as (select pessoa, renda, peso from persons where renda is not null), f as (select sum(peso) w, sum(peso * peso) ww, sum(peso * renda) / sum(peso) m from k),
 g as (select max(w) w, max(w * w / ww) n, sqrt(sum(peso * pow(renda - m, 2)) / max(w)) s from k, f), a as (select renda, sum(peso) over (order by renda) c from k), q as (select min(renda) q from a, g where c >= 0.9 * w - 1e-9 * w),
 h as (select q, 1.06 * s * pow(n, -0.2) h from g, q), d as (select sum(peso * exp(-0.5 * pow((renda - q) / h, 2)) / (h * sqrt(2 * pi()))) / sum(peso) d from k, h)
 select pessoa, round(q + (0.9 - (renda <= q)::int) / greatest(d, 1e-12), 3) rif from persons, h, d""")
def x22(spark, d):
    return P.influence(persons(spark, d).select("pessoa", "renda", "peso"), "renda", "peso", 0.9).select("pessoa", F.round("rif", 3).alias("rif"))


@query("x26_tolerance", WITH + ", o as (select c_nationkey::bigint ap, sum(1 + c_custkey % 7)::double tot from customer group by 1) select ap, round(100 * (v - tot) / tot, 4) desvio, abs(100 * (v - tot) / tot) <= 950 dentro from (select ap, sum(peso) v from persons group by ap) join o using (ap)")
def x26(spark, d):
    official = spark.read.parquet(f"{d}/customer.parquet").groupBy(c("c_nationkey").cast("long").alias("ap")).agg(F.sum(1 + c("c_custkey") % 7).cast("double").alias("tot"))
    off, good = P.within_tolerance(c("v"), c("tot"), 950)
    return persons(spark, d).groupBy("ap").agg(F.sum("peso").alias("v")).join(official, "ap").select("ap", F.round(off, 4).alias("desvio"), good.alias("dentro"))


@query("s17_report_table", WITH + """select segmento, case when v is null then '—' else translate(format('{:,.1f}', round(v, 1)), ',.', '.,') || case when n < 2950 then '**' when n < 3000 then '*' else '' end end valor
 from (select segmento, case when segmento <> 'BUILDING' then sum(renda) / 1000 end v, count(*) n from persons group by segmento)""")
def s17(spark, d):
    s = persons(spark, d).groupBy("segmento").agg(F.sum("renda").alias("v"), F.count("*").alias("n"))
    mark = P.precision_mark(F.when(c("n") < 2950, "baixa").when(c("n") < 3000, "cautela"))
    return s.select("segmento", P.report_cells(F.when(c("segmento") != "BUILDING", c("v") / 1000), 1, mark).alias("valor"))


@query("f07_interval", WITH + _BOOT + """, s as (select uf_atual, controle, sum(peso) x from persons group by all), p as (select uf_atual, sum(x) v from s group by all), r as (select uf_atual, b, sum(x * m) v from s join w using (controle) group by all),
 q as (select uf_atual, stddev_samp(v) e from r group by all) select uf_atual, round(greatest(0, v - 1.96 * e), 4) ic_inf, round(v + 1.96 * e, 4) ic_sup, case when 100 * e / v <= 15 then '' when 100 * e / v <= 30 then '*' else '**' end marca from p join q using (uf_atual)""")
def f07b(spark, d):
    est = E.total(persons(spark, d), weights(spark, d), ["uf_atual"], "controle", "peso")
    low, high = P.interval(c("value"), c("se"))
    return est.select("uf_atual", F.round(low, 4).alias("ic_inf"), F.round(high, 4).alias("ic_sup"), P.precision_mark(R.precision_class(100 * c("se") / c("value"))).alias("marca"))


@query("r34_adjusted_series", WITH + """, a as (select year, count(*) * 0.09::double ha from pixels group by year), k as (select *, case when year <= 1994 then 0.8 when year >= 1999 then 1.3 else 0.8 + (year - 1994) * 0.1 end f from a)
 select year, round(ha, 4) mapped, round(ha * f, 4) adjusted, round(ha * f * 0.9, 4) low, round(ha * f * 1.1, 4) high from k""")
def r34(spark, d):
    a = pixels(spark, d).groupBy("year").agg((F.count("*") * 0.09).alias("ha"))
    f = J.interpolate_lookup(a, "year", [(1994, 0.8), (1999, 1.3)])
    adjusted = c("ha") * c("value")
    return f.select("year", F.round("ha", 4).alias("mapped"), F.round(adjusted, 4).alias("adjusted"), F.round(adjusted * 0.9, 4).alias("low"), F.round(adjusted * 1.1, 4).alias("high"))


@query("j16_neighbour_years", WITH + """, g as (select year, row, col, median(red) red from pixels group by all) select a.year, a.row, a.col, round(avg(b.red), 6) near from g a join g b on b.row = a.row and b.col = a.col and abs(a.year - b.year) in (1, 2) group by all""")
def j16(spark, d):
    g = pixels(spark, d).groupBy("year", "row", "col").agg(F.median("red").alias("red"))
    near = J.neighbour_offsets(g, ["row", "col"], "year", "red", [-2, -1, 1, 2])
    return g.select("year", "row", "col").join(near, ["row", "col", "year"]).select("year", "row", "col", F.round("near", 6).alias("near"))


@query("j11_code_bands", "select p_partkey, case when p_size between 1 and 10 then 'pequeno' when p_size between 11 and 25 then 'medio' when p_size between 30 and 45 then 'grande' else 'outro' end faixa from part")
def j11(spark, d):
    bands = [(1, 10, "pequeno"), (11, 25, "medio"), (30, 45, "grande")]
    return R.range_recode(spark.read.parquet(f"{d}/part.parquet"), "p_size", bands, "faixa", "outro").select("p_partkey", "faixa")


@query("o02_top_parts", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15")
def o02(spark, d):
    from ..operators.migration import top_k

    return top_k(spark.read.parquet(f"{d}/part.parquet"), "p_retailprice", 15, "p_partkey").select("p_partkey", "p_retailprice")


@query("o03_slices_union", WITH + "select 'urbana' recorte, censo, count(*) n from persons where situacao = 'urbana' group by censo union all select 'idosos', censo, count(*) from persons where idade >= 60 group by censo union all select 'todos', censo, count(*) from persons group by censo")
def o03(spark, d):
    """Tables of several slices in one pass: each record goes to the slices that hold it."""
    held = {"urbana": c("situacao") == "urbana", "idosos": c("idade") >= 60, "todos": F.lit(True)}
    names = F.array_compact(F.array(*[F.when(k, F.lit(n)) for n, k in held.items()]))
    return persons(spark, d).select("censo", F.explode(names).alias("recorte")).groupBy("recorte", "censo").agg(F.count("*").alias("n"))


@query("x21_share_explained", WITH + """, k as (select renda y, anos_estudo::double x, peso w, situacao = 'urbana' g from persons where renda is not null and anos_estudo is not null and situacao is not null),
 s as (select g, sum(w) w, sum(w * x) x, sum(w * y) y, sum(w * x * x) xx, sum(w * x * y) xy from k group by g), b as (select *, (w * xy - x * y) / (w * xx - x * x) sl from s)
 select round(a.y / a.w - z.y / z.w, 6) gap, round(100 * (a.x / a.w - z.x / z.w) * z.sl / (a.y / a.w - z.y / z.w), 4) pct from b a, b z where a.g and not z.g""")
def x21b(spark, d):
    out = A.oaxaca(persons(spark, d), "renda", ["anos_estudo"], "peso", c("situacao") == "urbana")
    return out.select(F.round("gap", 6).alias("gap"), F.round(100 * c("endowments") / c("gap"), 4).alias("pct"))


@query("x24_increasing_breaks", WITH + ", q as (select quantile_cont(anos_estudo::double, [0.2, 0.4, 0.6, 0.8]) b from persons) select i::int i, round(list_aggregate([b[j] + 1e-6 * (i - j) for j in range(1, i + 1)], 'max'), 6) corte from q, range(1, 5) t(i)")
def x24b(spark, d):
    """Class breaks nudged up where quantiles tie, so that they increase strictly."""
    breaks = A.class_breaks(persons(spark, d).withColumn("v", c("anos_estudo").cast("double")), "v")
    return A.increasing(breaks).select("i", F.round("corte", 6).alias("corte"))
