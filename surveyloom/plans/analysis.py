"""Analysis tables: growth, elasticity, selectivity, inequality, exposure, difference in differences."""

from pyspark.sql import functions as F

from ..operators import analysis as A
from .fixtures import WITH, persons
from .ordered import _SERIES, series
from .registry import query


@query("x02_growth", _SERIES + "select a.nation, a.ano t0, b.ano t1, round(100 * (pow(b.v / a.v, 1 / 3.0) - 1), 6) taxa, round(b.v - a.v, 4) absoluto from s a join s b on a.nation = b.nation and a.ano = 1995 and b.ano = 1998")
def x02(spark, d):
    s = series(spark, d)
    a, b = (s.where(F.col("ano") == y).select("nation", F.col("ano").alias(f"t{i}"), F.col("v").alias(f"v{i}")) for i, y in enumerate((1995, 1998)))
    return a.join(b, "nation").select("nation", "t0", "t1", F.round(A.growth(F.col("v0"), F.col("v1"), F.lit(3.0)), 6).alias("taxa"), F.round(F.col("v1") - F.col("v0"), 4).alias("absoluto"))


@query("x03_elasticity", _SERIES + "select a.nation, round(ln(b.v / a.v) / nullif(ln(b.n / a.n), 0), 6) e from s a join s b on a.nation = b.nation and a.ano = 1995 and b.ano = 1998")
def x03(spark, d):
    s = series(spark, d)
    a, b = (s.where(F.col("ano") == y).select("nation", F.col("n").alias(f"n{i}"), F.col("v").alias(f"v{i}")) for i, y in enumerate((1995, 1998)))
    return a.join(b, "nation").select("nation", F.round(A.elasticity(F.col("v0"), F.col("v1"), F.col("n0"), F.col("n1")), 6).alias("e"))


_CUBE = WITH + ", cube as (select segmento unit, censo wave, status indicator, sum(peso) as value, sqrt(sum(peso * peso)) se from persons group by all) "


def cube(spark, d):
    p = persons(spark, d)
    return p.groupBy(F.col("segmento").alias("unit"), F.col("censo").alias("wave"), F.col("status").alias("indicator")).agg(F.sum("peso").alias("value"), F.sqrt(F.sum(F.col("peso") * F.col("peso"))).alias("se"))


@query("x07_selectivity", _CUBE + "select a.wave, a.indicator, round(a.value / b.value, 6) razao, round(a.value / b.value * sqrt(pow(a.se / a.value, 2) + pow(b.se / b.value, 2)), 6) ep, round(a.value - b.value, 4) dif, abs(a.value - b.value) > 1.96 * sqrt(a.se * a.se + b.se * b.se) sig from cube a join cube b on a.wave = b.wave and a.indicator = b.indicator and a.unit = 'BUILDING' and b.unit = 'MACHINERY'")
def x07(spark, d):
    c = cube(spark, d)
    a, b = (c.where(F.col("unit") == u).select("wave", "indicator", F.col("value").alias(f"v{i}"), F.col("se").alias(f"s{i}")) for i, u in enumerate(("BUILDING", "MACHINERY")))
    both = a.join(b, ["wave", "indicator"])
    args = [F.col(x) for x in ("v0", "s0", "v1", "s1")]
    ratio, se = A.ratio_delta(*args)
    diff, _, sure = A.difference_delta(*args)
    return both.select("wave", "indicator", F.round(ratio, 6).alias("razao"), F.round(se, 6).alias("ep"), F.round(diff, 4).alias("dif"), sure.alias("sig"))


@query("x10_inequality", WITH + "select uf_atual, count(*) n, round(sum(renda * peso) / sum(peso), 6) mean, round(min(renda), 6) low, round(max(renda), 6) high, round(stddev_pop(renda) / avg(renda), 6) cv, round(quantile_cont(renda, 0.1), 6) p10, round(quantile_cont(renda, 0.5), 6) p50, round(quantile_cont(renda, 0.9), 6) p90, round(quantile_cont(renda, 0.9) / nullif(quantile_cont(renda, 0.1), 0), 6) p90_p10 from persons where renda is not null group by uf_atual having count(*) >= 5")
def x10(spark, d):
    out = A.inequality(persons(spark, d), ["uf_atual"], "renda", "peso")
    return out.select("uf_atual", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "cv", "p10", "p50", "p90", "p90_p10")])


@query("x10_gradients", WITH + """, k as (select uf_atual, renda v, idade a from persons where renda is not null and idade is not null),
 r as (select *, rank() over (partition by uf_atual order by v) + (count(*) over (partition by uf_atual, v) - 1) / 2.0 rv, rank() over (partition by uf_atual order by a) + (count(*) over (partition by uf_atual, a) - 1) / 2.0 ra from k)
 select uf_atual, count(*) n, case when count(*) >= 5 then round(regr_slope(v, a), 6) end slope, case when count(*) >= 5 then round(corr(rv, ra), 6) end spearman from r group by uf_atual""")
def x10b(spark, d):
    """Slope and rank correlation of income along an axis, by unit."""
    out = A.gradients(persons(spark, d), ["uf_atual"], "renda", "idade")
    return out.select("uf_atual", "n", F.round("slope", 6).alias("slope"), F.round("spearman", 6).alias("spearman"))


@query("x13_did", _CUBE + """, m as (select a.unit, a.indicator, a.wave w0, b.wave w1, b.value - a.value d, sqrt(a.se * a.se + b.se * b.se) s from cube a join cube b on a.unit = b.unit and a.indicator = b.indicator join (values (1991, 2000), (2000, 2010), (2010, 2022)) p(w0, w1) on a.wave = p.w0 and b.wave = p.w1)
 select f.indicator, f.w0, f.w1, c.unit control, round(f.d - c.d, 4) did, round(sqrt(f.s * f.s + c.s * c.s), 4) se, abs(f.d - c.d) > 1.96 * sqrt(f.s * f.s + c.s * c.s) significant from m f join m c on f.indicator = c.indicator and f.w0 = c.w0 and f.w1 = c.w1 and f.unit = 'BUILDING' and c.unit in ('MACHINERY', 'FURNITURE')""")
def x13(spark, d):
    out = A.did(cube(spark, d), "BUILDING", ["MACHINERY", "FURNITURE"], [(1991, 2000), (2000, 2010), (2010, 2022)])
    return out.withColumns({"did": F.round("did", 4), "se": F.round("se", 4)})


@query("x18_exposure_tiers", "with c as (select median(c_acctbal) filter (c_acctbal > 0) a, quantile_cont(c_acctbal, 0.9) filter (c_acctbal > 0) b from customer) select c_custkey, case when not c_acctbal > 0 then 'nenhuma' when c_acctbal >= b then 'alta' when c_acctbal >= a then 'media' else 'baixa' end tier from customer, c")
def x18(spark, d):
    return A.exposure_tiers(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "tier")


@query("x20_share_ratio", WITH + "select segmento, round((count(*) filter (idade >= 60) / sum(count(*) filter (idade >= 60)) over ()) / (count(*) / sum(count(*)) over ()), 6) lee from persons group by segmento")
def x20(spark, d):
    from pyspark.sql.window import Window

    c = persons(spark, d).groupBy("segmento").agg(F.count_if(F.col("idade") >= 60).alias("a"), F.count("*").alias("n"))
    every = Window.partitionBy()  # a row per segment
    return c.select("segmento", F.round((F.col("a") / F.sum("a").over(every)) / (F.col("n") / F.sum("n").over(every)), 6).alias("lee"))


@query("x21_oaxaca", WITH + """, k as (select idade::double x, renda y, peso w, situacao = 'urbana' g from persons where idade is not null and renda is not null and situacao is not null),
 s as (select g, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my, sum(w * x * x) / sum(w) mxx, sum(w * x * y) / sum(w) mxy from k group by g), b as (select g, mx, my, (mxy - mx * my) / (mxx - mx * mx) b, my - (mxy - mx * my) / (mxx - mx * mx) * mx a from s)
 select round(u.my - r.my, 4) gap, round((u.mx - r.mx) * r.b, 4) endowments, round(u.a - r.a + r.mx * (u.b - r.b), 4) coefficients, round((u.mx - r.mx) * (u.b - r.b), 4) interaction from b u join b r on u.g and not r.g""")
def x21(spark, d):
    out = A.oaxaca(persons(spark, d), "renda", ["idade"], "peso", F.col("situacao") == "urbana")
    return out.select(*[F.round(c, 4).alias(c) for c in ("gap", "endowments", "coefficients", "interaction")])


_THREE = WITH + """, k as (select idade::double a, anos_estudo::double b, tempo_moradia::double c, renda y, peso w, situacao = 'urbana' g from persons),
 z as (select * from k where a is not null and b is not null and c is not null and y is not null and g is not null),
 s as (select g, count(*) n, sum(w * a) / sum(w) ma, sum(w * b) / sum(w) mb, sum(w * c) / sum(w) mc, sum(w * y) / sum(w) my,
  sum(w * a * a) / sum(w) aa, sum(w * a * b) / sum(w) ab, sum(w * a * c) / sum(w) ac, sum(w * b * b) / sum(w) bb, sum(w * b * c) / sum(w) bc, sum(w * c * c) / sum(w) cc,
  sum(w * a * y) / sum(w) ay, sum(w * b * y) / sum(w) yb, sum(w * c * y) / sum(w) cy from z group by g),
 v as (select g, n, ma, mb, mc, my, aa - ma * ma p, ab - ma * mb q, ac - ma * mc r, bb - mb * mb t, bc - mb * mc u, cc - mc * mc x, ay - ma * my ya, yb - mb * my yb, cy - mc * my yc from s),
 dt as (select *, p * (t * x - u * u) - q * (q * x - u * r) + r * (q * u - t * r) det from v),
 e as (select g, n, ma, mb, mc, my, (ya * (t * x - u * u) - q * (yb * x - u * yc) + r * (yb * u - t * yc)) / det ba,
  (p * (yb * x - u * yc) - ya * (q * x - u * r) + r * (q * yc - yb * r)) / det bb, (p * (t * yc - yb * u) - q * (q * yc - yb * r) + ya * (q * u - t * r)) / det bc from dt) """
_SPLIT = _THREE + """, h as (select i.my - j.my gap, (i.ma - j.ma) * j.ba + (i.mb - j.mb) * j.bb + (i.mc - j.mc) * j.bc en,
  (i.ma - j.ma) * (i.ba - j.ba) + (i.mb - j.mb) * (i.bb - j.bb) + (i.mc - j.mc) * (i.bc - j.bc) it, i.n n_a, j.n n_b from e i join e j on i.g and not j.g) """
REGRESSORS = ["idade", "anos_estudo", "tempo_moradia"]


@query("x21_three_regressors", _SPLIT + "select round(gap, 4) gap, round(en, 4) endowments, round(gap - en - it, 4) coefficients, round(it, 4) interaction, round(100 * en / gap, 3) pct_explained, n_a, n_b from h")
def x21c(spark, d):
    out = A.oaxaca(persons(spark, d), "renda", REGRESSORS, "peso", F.col("situacao") == "urbana")
    return out.select(*[F.round(c, 4).alias(c) for c in ("gap", "endowments", "coefficients", "interaction")], F.round("pct_explained", 3).alias("pct_explained"), "n_a", "n_b")


@query("x21_terms", _THREE + """select name, round(mean_a, 6) mean_a, round(slope_a, 6) slope_a, round(slope_b, 6) slope_b from (
 select 'idade' as name, i.ma mean_a, i.ba slope_a, j.ba slope_b from e i join e j on i.g and not j.g union all
 select 'anos_estudo', i.mb, i.bb, j.bb from e i join e j on i.g and not j.g union all select 'tempo_moradia', i.mc, i.bc, j.bc from e i join e j on i.g and not j.g)""")
def x21d(spark, d):
    """Means and slopes of every regressor in the split."""
    out = A.oaxaca(persons(spark, d), "renda", REGRESSORS, "peso", F.col("situacao") == "urbana").selectExpr("inline(terms)")
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("mean_a", "slope_a", "slope_b")])


@query("x23_trend", _SERIES + "select nation, round(regr_slope(v, ano), 4) slope, round(regr_intercept(v, ano), 2) intercept from s group by nation")
def x23(spark, d):
    return series(spark, d).groupBy("nation").agg(F.round(F.regr_slope("v", "ano"), 4).alias("slope"), F.round(F.regr_intercept("v", "ano"), 2).alias("intercept"))


@query("x24_breaks", "select unnest([0, 1, 2, 3])::int i, round(unnest(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8])), 6) quebra from orders")
def x24(spark, d):
    out = A.class_breaks(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice")
    return out.select(F.posexplode("breaks").alias("i", "q")).select("i", F.round("q", 6).alias("quebra"))


@query("x26_reconciliation", WITH + ", o as (select n_nationkey k, 900.0 + n_nationkey oficial from nation) select ap, sum(peso) estimado, round(100 * (sum(peso) - max(oficial)) / max(oficial), 6) desvio from persons join o on k = ap group by ap")
def x26(spark, d):
    o = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("ap"), (900.0 + F.col("n_nationkey")).alias("oficial"))
    out = persons(spark, d).join(o, "ap").groupBy("ap").agg(F.sum("peso").alias("estimado"), F.max("oficial").alias("o"))
    return out.select("ap", "estimado", F.round(100 * (F.col("estimado") - F.col("o")) / F.col("o"), 6).alias("desvio"))
