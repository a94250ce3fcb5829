"""Measures over pixels, series and categories seen in the driver's tables."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import measures as M
from ..operators.quantiles import quantiles
from .fixtures import WITH, persons, pixels
from .registry import query

c = F.col
_PIXELS = WITH + ", p as (select *, (nir - red) / (nir + red) ndvi from pixels where nir + red > 0) "


def indexed(spark, d):
    return pixels(spark, d).where("nir + red > 0").withColumn("ndvi", (c("nir") - c("red")) / (c("nir") + c("red")))


@query("r02_harmonise", WITH + "select scene, qa, round(case when qa <= 3 then 0.98::double * red + 0.5::double else red end, 6) red from pixels")
def r02(spark, d):
    return pixels(spark, d).select("scene", "qa", F.round(F.when(c("qa") <= 3, 0.98 * c("red") + 0.5).otherwise(c("red")), 6).alias("red"))


@query("r05_wet_season_max", _PIXELS + ', y as (select "row", col, year, max(ndvi) own, count(ndvi) n from p group by all) select "row", col, year, round(case when n < 3 then max(own) over (partition by "row", col order by year range between 1 preceding and 1 following) else own end, 6) ndvi from y')
def r05(spark, d):
    return M.borrowed_maximum(indexed(spark, d), ["row", "col"], "year", "ndvi", 3).withColumn("ndvi", F.round("ndvi", 6))


@query("r09_amplitude", _PIXELS + 'select "row", col, year, round(coalesce(max(ndvi) filter (qa <= 3), 0) - coalesce(min(ndvi) filter (qa > 3), 0), 6) amplitude from p group by all')
def r09(spark, d):
    wet, dry = F.max(F.when(c("qa") <= 3, c("ndvi"))), F.min(F.when(c("qa") > 3, c("ndvi")))
    return indexed(spark, d).groupBy("row", "col", "year").agg(F.round(F.coalesce(wet, F.lit(0.0)) - F.coalesce(dry, F.lit(0.0)), 6).alias("amplitude"))


@query("r10_slope", WITH + ', z as (select "row", col, sum(red) z from pixels group by all) select a."row", a.col, round(degrees(atan(sqrt(pow((e.z - w.z) / 60, 2) + pow((s.z - n.z) / 60, 2)))), 6) slope from z a left join z e on e."row" = a."row" and e.col = a.col + 1 left join z w on w."row" = a."row" and w.col = a.col - 1 left join z s on s.col = a.col and s."row" = a."row" + 1 left join z n on n.col = a.col and n."row" = a."row" - 1')
def r10(spark, d):
    grid = pixels(spark, d).groupBy("row", "col").agg(F.sum("red").alias("z"))
    return M.slope_degrees(grid, "row", "col", "z", 30.0).withColumn("slope", F.round("slope", 6))


_CLASS = "case when red > 45 then 3 when nir > 60 then 1 when swir > 8 and year >= 1995 then 4 else 2 end"


@query("r23_class_area", WITH + f"select year, {_CLASS} cls, round(count(*) * 0.09, 6)::double ha from pixels group by all")
def r23(spark, d):
    cls = F.when(c("red") > 45, 3).when(c("nir") > 60, 1).when((c("swir") > 8) & (c("year") >= 1995), 4).otherwise(2)
    return pixels(spark, d).groupBy("year", cls.alias("cls")).agg(F.round(F.count("*") * 0.09, 6).alias("ha"))


@query("r27_stratified_sample", "select doc_id, lang, size from (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) r, count(*) over (partition by lang) size from documents) where r <= 25")
def r27(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    return M.stratified_sample(docs, "lang", "doc_id", 25).select("doc_id", "lang", "size")


@query("r30_binary_scores", WITH + ", k as (select year, count(*) filter (nir > 35 and red > 25) tp, count(*) filter (nir > 35 and red <= 25) fp, count(*) filter (nir <= 35 and red > 25) fn, count(*) filter (nir <= 35 and red <= 25) tn from pixels group by year) select year, round((tp + tn) / (tp + fp + fn + tn), 6) oa, round(tp / (tp + fp), 6) ua, round(tp / (tp + fn), 6) pa, round(2 * tp / (2 * tp + fp + fn), 6) f1 from k")
def r30(spark, d):
    out = M.binary_scores(pixels(spark, d), ["year"], c("nir") > 35, c("red") > 25)
    return out.withColumns({k: F.round(k, 6) for k in ("oa", "ua", "pa", "f1")})


@query("r31_fraction_bands", WITH + "select scene, qa, case when red <= 10 then 'baixa' when red <= 30 then 'media' else 'alta' end faixa from pixels")
def r31(spark, d):
    return pixels(spark, d).select("scene", "qa", R.band(c("red"), [10, 30], ["baixa", "media", "alta"]).alias("faixa"))


@query("r35_stretch", WITH + "select round(quantile_cont(red, 0.02), 6) red_lo, round(quantile_cont(red, 0.98), 6) red_hi, round(quantile_cont(nir, 0.02), 6) nir_lo, round(quantile_cont(nir, 0.98), 6) nir_hi from pixels")
def r35(spark, d):
    cuts = [quantiles(pixels(spark, d), [], b, {f"{b}_lo": 0.02, f"{b}_hi": 0.98}) for b in ("red", "nir")]
    both = cuts[0].crossJoin(cuts[1])  # a row each
    return both.select(*[F.round(k, 6).alias(k) for k in both.columns])


@query("r36_zone_values", WITH + 'select ("row" // 10)::bigint zr, (col // 10)::bigint zc, year, round(median(nir), 6) mediana, round(avg(nir), 6) media from pixels group by all')
def r36(spark, d):
    zones = [F.floor(c(k) / 10).alias(n) for k, n in (("row", "zr"), ("col", "zc"))]
    return pixels(spark, d).groupBy(*zones, "year").agg(F.round(F.median("nir"), 6).alias("mediana"), F.round(F.avg("nir"), 6).alias("media"))


@query("r38_mosaic", WITH + 'select "row", col, year, red from pixels where swir > 0 qualify row_number() over (partition by "row", col, year order by scene desc, qa desc, red desc) = 1')
def r38(spark, d):
    return M.mosaic(pixels(spark, d), ["row", "col", "year"], "red", ["scene", "qa"], c("swir") > 0)


@query("r39_valid_fraction", WITH + "select scene, round(avg((swir > 2)::int), 6) fracao, avg((swir > 2)::int) >= 0.5 mantida from pixels group by scene")
def r39(spark, d):
    share = F.avg((c("swir") > 2).cast("int"))
    return pixels(spark, d).groupBy("scene").agg(F.round(share, 6).alias("fracao"), (share >= 0.5).alias("mantida"))


_YEARS = WITH + ", s as (select segmento, ano, sum(peso) filter (status = 'F') f, sum(peso) filter (status = 'O') o, sum(peso) v, count(*) n from persons group by all) "


def yearly(spark, d):
    part = lambda s: F.sum(F.when(c("status") == s, c("peso")))
    return persons(spark, d).groupBy("segmento", "ano").agg(part("F").alias("f"), part("O").alias("o"), F.sum("peso").alias("v"), F.count("*").alias("n"))


@query("x04_land_to_population", _YEARS + "select a.segmento, round(ln(b.v / a.v) / ln(b.n / a.n), 6) razao from s a join s b using (segmento) where a.ano = 1996 and b.ano = 2000 and a.n <> b.n")
def x04(spark, d):
    at = lambda k, y: F.max(F.when(c("ano") == y, c(k)))
    ends = yearly(spark, d).groupBy("segmento").agg(*[at(k, y).alias(f"{k}{y}") for k in "vn" for y in (1996, 2000)]).where("n1996 <> n2000")
    return ends.select("segmento", F.round(F.ln(c("v2000") / c("v1996")) / F.ln(c("n2000") / c("n1996")), 6).alias("razao"))


@query("x15_year_spine", _YEARS + "select g.segmento, y.ano::int ano, coalesce(n, 0) n from (select distinct segmento from s) g cross join range(1990, 2001) y(ano) left join s on s.segmento = g.segmento and s.ano = y.ano")
def x15(spark, d):
    s = yearly(spark, d).select("segmento", "ano", "n")
    spine = s.select("segmento").distinct().select("segmento", F.explode(F.sequence(F.lit(1990), F.lit(2000))).alias("ano"))
    return spine.join(s, ["segmento", "ano"], "left").fillna(0, ["n"])


@query("x17_exposure", "select c_nationkey, round(coalesce(sum(o_totalprice) filter (year(o_orderdate) between 1995 and 1997), 0) / 3 / count(distinct c_custkey), 4) per_capita from customer left join orders on o_custkey = c_custkey group by c_nationkey")
def x17(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").where(F.year("o_orderdate").between(1995, 1997)).groupBy(c("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    units = spark.read.parquet(f"{d}/customer.parquet").join(orders, "c_custkey", "left").groupBy("c_nationkey").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"), F.count("*").alias("n"))
    return units.select("c_nationkey", F.round(c("v") / 3 / c("n"), 4).alias("per_capita"))


@query("x25_agreement", _YEARS + "select segmento, count(*) n, round(corr(f, o), 6) corr, round(median(o / f), 6) ratio from s where f is not null and o is not null group by segmento")
def x25(spark, d):
    return M.agreement(yearly(spark, d), ["segmento"], "f", "o").withColumns({k: F.round(k, 6) for k in ("corr", "ratio")})


@query("x25_drops", _YEARS + "select * from (select segmento, ano, v, lag(v) over (partition by segmento order by ano) as before from s) where v < 0.99 * before")
def x25b(spark, d):
    return M.drops(yearly(spark, d), ["segmento"], "ano", "v", 0.01).select("segmento", "ano", "v", "before")


_AGE = "case when idade >= 80 then '80_mais' when idade is not null then lpad((idade // 5 * 5)::varchar, 2, '0') || '_' || lpad((idade // 5 * 5 + 4)::varchar, 2, '0') end"


@query("x27_pyramid", WITH + f", g as (select censo, {_AGE} faixa, sexo_cod, sum(peso) w from persons where sexo_cod in ('1', '2') and idade is not null group by all) select censo, faixa, sexo_cod, round(100 * w / sum(w) over (partition by censo), 6) pct from g")
def x27(spark, d):
    people = persons(spark, d).where("sexo_cod in ('1', '2') and idade is not null").withColumn("faixa", R.age_band(c("idade")))
    cells = people.groupBy("censo", "faixa", "sexo_cod").agg(F.sum("peso").alias("w"))
    both = cells.groupBy("censo").agg(F.sum("w").alias("t"))
    return cells.join(both, "censo").select("censo", "faixa", "sexo_cod", F.round(100 * c("w") / c("t"), 6).alias("pct"))


@query("x28_stacked", WITH + ', g as (select censo, case when raca_cod in (\'1\', \'3\') then \'a\' when raca_cod in (\'2\', \'4\') then \'b\' else \'c\' end grupo, sum(peso) total from persons group by all) select *, sum(total) over (partition by censo order by grupo) - total as "offset" from g')
def x28(spark, d):
    group = F.when(c("raca_cod").isin("1", "3"), "a").when(c("raca_cod").isin("2", "4"), "b").otherwise("c")
    return M.stacked_groups(persons(spark, d).withColumn("grupo", group), ["censo"], "grupo", "peso")


@query("a01_household_sums", WITH + "select ap, controle, sum(peso) w, round(sum(peso * renda), 4) wy from persons where renda is not null group by all")
def a01(spark, d):
    return persons(spark, d).where("renda is not null").groupBy("ap", "controle").agg(F.sum("peso").alias("w"), F.round(F.sum(c("peso") * c("renda")), 4).alias("wy"))


@query("a10_universes", WITH + "select 'pessoas' universo, count(*) n, sum(peso) total from persons union all select 'ocupados', count(*), sum(peso) from persons where status = 'O' union all select 'com_renda', count(*), sum(peso) from persons where renda > 0")
def a10(spark, d):
    tests = {"pessoas": F.lit(True), "ocupados": c("status") == "O", "com_renda": c("renda") > 0}
    inside = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return persons(spark, d).select("peso", F.explode(inside).alias("universo")).groupBy("universo").agg(F.count("*").alias("n"), F.sum("peso").alias("total"))


@query("a23_participation", WITH + "select segmento, round(100 * sum(peso) filter (status = 'F') / sum(peso) filter (status in ('F', 'O')), 6) pct from persons group by segmento")
def a23(spark, d):
    part = lambda *s: F.sum(F.when(c("status").isin(*s), c("peso")))
    return persons(spark, d).groupBy("segmento").agg(part("F").alias("a"), part("F", "O").alias("b")).select("segmento", F.round(F.try_divide(100 * c("a"), c("b")), 6).alias("pct"))


@query("b09_list_counts", "select w palavra, count(*) n from (select unnest(string_split(p_type, ' ')) w from part) group by w")
def b09(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_type", " ")).alias("palavra")).groupBy("palavra").agg(F.count("*").alias("n"))


@query("b09_status_log", "select p_brand marca, case when p_size > 40 then 'grande' when p_retailprice < 950 then 'barato' else 'ok' end status, count(*) n from part group by all union all select p_brand, 'total', count(*) from part group by all")
def b09b(spark, d):
    from ..operators.linkage import status_log

    reason = F.when(c("p_size") > 40, "grande").when(c("p_retailprice") < 950, "barato")
    return status_log(spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_brand", "marca"), "marca", reason)


@query("f11_slugs", r"select p_partkey, case when count(*) over (partition by b) > 1 then b || '_' || row_number() over (partition by b order by p_partkey) else b end slug from (select p_partkey, regexp_extract(p_name, '[a-z]+$', 0) || p_size || regexp_extract(lower(p_type), '[a-z]{4,}', 0) b from part)")
def f11(spark, d):
    """Author's last name, year and the first long word of the title, numbered where several records share them."""
    base = F.concat(F.regexp_extract("p_name", "[a-z]+$", 0), c("p_size").cast("string"), F.regexp_extract(F.lower("p_type"), "[a-z]{4,}", 0))
    return M.numbered_slugs(spark.read.parquet(f"{d}/part.parquet"), base, "p_partkey").select("p_partkey", "slug")


@query("s18_row_counts", "select 'orders' tabela, count(*) n, count(distinct o_orderkey) chaves from orders union all select 'lineitem', count(*), count(distinct l_orderkey) from lineitem")
def s18(spark, d):
    one = lambda t, k: spark.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias("n"), F.count_distinct(k).alias("chaves")).select(F.lit(t).alias("tabela"), "n", "chaves")
    return one("orders", "o_orderkey").unionByName(one("lineitem", "l_orderkey"))
