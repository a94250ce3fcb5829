"""Joins, ordered series, sorts and set operations."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as J
from ..operators import series as S
from ..sources import versions as V
from .fixtures import WITH, dwellings, persons
from .registry import query

_SERIES = "with s as (select c_nationkey nation, year(o_orderdate)::int ano, sum(o_totalprice) v, count(*) n from orders join customer on o_custkey = c_custkey group by all) "


def series(spark, d):
    o, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("ano")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


@query("w01_change", _SERIES + "select nation, ano, round(v - lag(v) over w, 4) diff, round(100 * (v - lag(v) over w) / lag(v) over w, 6) pct from s window w as (partition by nation order by ano)")
def w01(spark, d):
    return S.change(series(spark, d), ["nation"], "ano", "v").select("nation", "ano", F.round("diff", 4).alias("diff"), F.round("pct", 6).alias("pct"))


@query("w02_lagged_correlation", _SERIES + """, p as (select nation, k lag, case k when 0 then n when 1 then lag(n, 1) over w when 2 then lag(n, 2) over w else lag(n, 3) over w end x, v y from s, range(4) t(k) window w as (partition by nation, k order by ano)),
 r as (select *, rank() over (partition by nation, lag order by x) + (count(*) over (partition by nation, lag, x) - 1) / 2.0 rx, rank() over (partition by nation, lag order by y) + (count(*) over (partition by nation, lag, y) - 1) / 2.0 ry from p where x is not null)
 select nation, lag::int lag, count(*) n, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman from r group by nation, lag""")
def w02(spark, d):
    return S.lagged_correlation(series(spark, d), "nation", "ano", "n", "v", [0, 1, 2, 3]).withColumns({"pearson": F.round("pearson", 6), "spearman": F.round("spearman", 6)})


@query("w03_against_first", _SERIES + "select nation, ano, round(v - first_value(v) over (partition by nation order by ano), 4) d from s")
def w03(spark, d):
    return series(spark, d).select("nation", "ano", F.round(F.col("v") - F.first("v").over(Window.partitionBy("nation").orderBy("ano")), 4).alias("d"))


@query("w04_top_n", "select * from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int r from orders) where r <= 2")
def w04(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r")).where("r <= 2")


@query("w05_first_per_key", "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey from orders group by 1")
def w05(spark, d):
    return S.first_per_key(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w06_best_dates", "with m as (select event_type, ts::date dia, avg(value) m from events group by all), b as (select * from (select *, row_number() over (partition by event_type order by m desc, dia) r from m) where r <= 3) select event_id from events e semi join b on e.event_type = b.event_type and e.ts::date = b.dia")
def w06(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").withColumn("dia", F.to_date("ts"))
    m = ev.groupBy("event_type", "dia").agg(F.avg("value").alias("m"))
    best = m.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("m"), "dia"))).where("r <= 3")
    return ev.join(best, ["event_type", "dia"], "left_semi").select("event_id")


@query("w07_runs", _SERIES + ", g as (select nation, ano, ano - row_number() over (partition by nation order by ano) g from s where n >= 80) select nation, min(ano) start, max(ano) \"end\", count(*) length from g group by nation, g")
def w07(spark, d):
    return S.runs(series(spark, d), ["nation"], "ano", F.col("n") >= 80)


@query("w08_anchor_pairs", _SERIES + ", a as (select * from s where ano in (1995, 1998, 2001)) select * from (select nation, ano t0, lead(ano) over w t1, round(v, 4) v0, round(lead(v) over w, 4) v1 from a window w as (partition by nation order by ano)) where t1 is not null")
def w08(spark, d):
    return S.anchor_pairs(series(spark, d).where(F.col("ano").isin(1995, 1998, 2001)), ["nation"], "ano", "v").withColumns({"v0": F.round("v0", 4), "v1": F.round("v1", 4)})


@query("w09_interpolation", _SERIES + """, k as (select nation, ano, case when ano in (1995, 1998, 2001) then v end known from s),
 m as (select *, last_value(known ignore nulls) over b v0, last_value(case when known is not null then ano end ignore nulls) over b t0, first_value(known ignore nulls) over a v1, first_value(case when known is not null then ano end ignore nulls) over a t1 from k
  window b as (partition by nation order by ano rows between unbounded preceding and current row), a as (partition by nation order by ano rows between current row and unbounded following))
 select nation, ano, round(case when t0 = t1 then known when v0 is not null and v1 is not null then v0 * pow(v1 / v0, (ano - t0) / (t1 - t0)) end, 4) as value from m""")
def w09(spark, d):
    spine = series(spark, d).select("nation", "ano", F.when(F.col("ano").isin(1995, 1998, 2001), F.col("v")).alias("known"))
    return S.geometric_interpolate(spine, ["nation"], "ano", "known").select("nation", "ano", F.round("value", 4).alias("value"))


@query("w09_extrapolation", _SERIES + """, k as (select nation, ano, n, case when ano in (1994, 1996) then v end known from s),
 m as (select *, last_value(known ignore nulls) over b v0, last_value(case when known is not null then ano end ignore nulls) over b t0, last_value(case when known is not null then n end ignore nulls) over b n0,
  first_value(known ignore nulls) over a v1, first_value(case when known is not null then ano end ignore nulls) over a t1 from k
  window b as (partition by nation order by ano rows between unbounded preceding and current row), a as (partition by nation order by ano rows between current row and unbounded following))
 select nation, ano, case when t0 = t1 then 'observed' when v0 is not null and v1 is not null then 'interpolated' when v0 is not null then 'extrapolated' end origin,
  round(case when t0 = t1 then known when v0 is not null and v1 is not null then v0 * pow(v1 / v0, (ano - t0) / (t1 - t0)) when v0 is not null then v0 * n / n0 end, 2) as value from m""")
def w09b(spark, d):
    """After the last anchor the value moves with another series, here the counts; each value says where it comes from."""
    spine = series(spark, d).select("nation", "ano", "n", F.when(F.col("ano").isin(1994, 1996), F.col("v")).alias("known"))
    return S.geometric_interpolate(spine, ["nation"], "ano", "known", "n").select("nation", "ano", "origin", F.round("value", 2).alias("value"))


@query("w10_average_rank", WITH + "select pessoa, rank() over (partition by segmento order by idade) + (count(*) over (partition by segmento, idade) - 1) / 2.0 r from persons where idade is not null")
def w10(spark, d):
    return S.ranked(persons(spark, d).select("pessoa", "segmento", "idade"), ["segmento"], "idade", "r").select("pessoa", "r")


@query("w12_period_sums", _SERIES + "select nation, t0, t1, round(sum(v), 4) as value from s join (values (1995, 1998), (1998, 2001)) p(t0, t1) on ano > t0 and ano <= t1 group by all")
def w12(spark, d):
    return S.period_sums(series(spark, d), ["nation"], "ano", "v", [(1995, 1998), (1998, 2001)]).withColumn("value", F.round("value", 4))


@query("w14_peak", _SERIES + "select nation, arg_max(ano, v) ano, round(max(v), 4) v from s group by nation")
def w14(spark, d):
    return series(spark, d).groupBy("nation").agg(F.max_by("ano", "v").alias("ano"), F.round(F.max("v"), 4).alias("v"))


@query("j01_enrich", WITH + "select pessoa, d.tipo from persons p join dwellings d on p.controle = d.controle where d.agua is not null")
def j01(spark, d):
    return persons(spark, d).join(dwellings(spark, d).where("agua is not null").select("controle", "tipo"), "controle").select("pessoa", "tipo")


@query("j01_unmatched", WITH + "select count(*) n, count(*) filter (d.controle is null) dropped from persons p left join (select * from dwellings where agua is not null) d on p.controle = d.controle")
def j01b(spark, d):
    """Persons whose household is unknown are left out of the enrichment; here they are counted."""
    known = dwellings(spark, d).where("agua is not null").select("controle", F.lit(True).alias("k"))
    return persons(spark, d).join(known, "controle", "left").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("dropped"))


@query("j07_reconcile", "select coalesce(a.k, b.k) k, case when b.k is null then 'missing' when a.k is null then 'extra' when a.h is not distinct from b.h then 'equal' else 'different' end status from (select o_orderkey k, o_orderstatus h from orders) a full join (select l_orderkey k, max(l_linestatus) h from lineitem group by l_orderkey) b on a.k = b.k")
def j07(spark, d):
    orders, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "lineitem"))
    a = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("h"))
    b = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("h"))
    return J.reconcile(a, b, ["k"], "h")


@query("j08_nearest", "with l as (select s_nationkey g, s_suppkey k, s_acctbal x, s_suppkey * 1.0 y from supplier), r as (select c_nationkey g, c_custkey o, c_acctbal x, c_custkey * 1.0 y from customer) select g, k, arg_min(o, (d, o)) o, round(min(d), 6) distance from (select l.g, k, o, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) d from l join r on l.g = r.g) group by g, k")
def j08(spark, d):
    l = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    r = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("o"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return J.nearest_in_group(l, r, "g", "k", "o", "x", "y").withColumn("distance", F.round("distance", 6))


@query("j08_nearest_order", "with p as (select o_orderkey k, c_mktsegment g, o_orderdate::date - date '1992-01-01' x, o_totalprice / 100 y, o_orderstatus s from orders join customer on o_custkey = c_custkey), l as (select * from p where s = 'P'), r as (select * from p where s = 'F') select g, k, arg_min(o, (d, o)) o, round(min(d), 6) distance from (select l.g, l.k, r.k o, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) d from l join r on l.g = r.g) group by g, k")
def j08b(spark, d):
    """The closest finished order in time and price to each order under way, within five segments."""
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    p = o.join(c, o.o_custkey == c.c_custkey).selectExpr("o_orderkey as k", "c_mktsegment as g", "cast(datediff(o_orderdate, date'1992-01-01') as double) as x", "o_totalprice / 100 as y", "o_orderstatus as s")
    left, right = p.where("s = 'P'"), p.where("s = 'F'").withColumnRenamed("k", "o")
    return J.nearest_in_group(left, right, "g", "k", "o", "x", "y").withColumn("distance", F.round("distance", 6))


@query("j10_interpolate_lookup", WITH + "select pessoa, round(case when idade <= 10 then 0.5 when idade <= 40 then 0.5 + (idade - 10) * (0.9 - 0.5) / 30 when idade <= 70 then 0.9 + (idade - 40) * (0.7 - 0.9) / 30 when idade > 70 then 0.7 end::double, 8) as value, case when idade in (10, 40, 70) then 'exact' when idade > 10 and idade < 70 then 'between' when idade is not null then 'outside' end origin from persons")
def j10(spark, d):
    out = J.interpolate_lookup(persons(spark, d).select("pessoa", "idade"), "idade", [(10, 0.5), (40, 0.9), (70, 0.7)])
    return out.select("pessoa", F.round("value", 8).alias("value"), "origin")


@query("j12_point_in_zone", "select p.k, z from (select l_orderkey * 10 + l_linenumber k, l_partkey % 40 + 0.5 x, l_suppkey % 40 + 0.5 y from lineitem) p, (values ('a', 2, 3, 17, 21), ('b', 15, 10, 38, 30)) z(z, x0, y0, x1, y1) where x > x0 and x < x1 and y > y0 and y < y1")
def j12(spark, d):
    pts = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber as k", "l_partkey % 40 + 0.5D as x", "l_suppkey % 40 + 0.5D as y")
    box = lambda x0, y0, x1, y1: [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]
    zones = spark.createDataFrame([("a", box(2, 3, 17, 21)), ("b", box(15, 10, 38, 30))], "z string, ring array<struct<x: double, y: double>>")
    return J.point_in_zone(pts, zones, "x", "y", "z", "ring").select("k", "z")


# Concave zones, one a nation, that grow with its key and overlap their neighbours.
_ZONE_X = "n_nationkey * 1.5 + 0.3", "n_nationkey * 1.5 + 9.7", "n_nationkey * 1.5 + 6.1", "n_nationkey * 1.5 + 10.2", "n_nationkey * 1.5 + 0.8", "n_nationkey * 1.5 + 4.4"
_ZONE_Y = "1.2", "n_nationkey + 2.7", "n_nationkey * 0.5 + 9.1", "n_nationkey + 14.6", "n_nationkey + 12.3", "n_nationkey * 0.5 + 7.7"


@query("j12_concave_zones", f"""with z as (select n_nationkey z, [{', '.join(_ZONE_X)}]::double[] xs, [{', '.join(_ZONE_Y)}]::double[] ys from nation),
 p as (select l_orderkey * 10 + l_linenumber k, l_partkey % 4000 / 100.0 x, l_suppkey * 7 % 400 / 10.0 y from lineitem)
 select k, z from p, z where list_sum([case when (ys[i] > y) <> (ys[i % 6 + 1] > y) and x < (xs[i % 6 + 1] - xs[i]) * (y - ys[i]) / (ys[i % 6 + 1] - ys[i]) + xs[i] then 1 else 0 end for i in range(1, 7)]) % 2 = 1""")
def j12b(spark, d):
    pts = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber as k", "l_partkey % 4000 / 100D as x", "l_suppkey * 7 % 400 / 10D as y")
    corners = ", ".join(f"named_struct('x', cast({x} as double), 'y', cast({y} as double))" for x, y in zip(_ZONE_X, _ZONE_Y))
    zones = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as z", f"array({corners}) as ring")
    return J.point_in_zone(pts, zones, "x", "y", "z", "ring").select("k", "z")


@query("j14_precedence", _SERIES + ", u as (select nation, ano, n, 0 source from s where ano % 3 = 0 union all select nation, ano, n + 1, 1 from s where ano % 2 = 0 union all select nation, ano, n + 2, 2 from s) select nation, ano, n, source::int source from (select *, row_number() over (partition by nation, ano order by source) r from u) where r = 1")
def j14(spark, d):
    s = series(spark, d).select("nation", "ano", "n")
    parts = [s.where("ano % 3 = 0"), s.where("ano % 2 = 0").withColumn("n", F.col("n") + 1), s.withColumn("n", F.col("n") + 2)]
    return J.precedence_union(parts, ["nation", "ano"])


@query("j15_period_join", _SERIES + "select a.nation, a.ano t0, b.ano t1, round(b.v / a.v, 6) razao from s a join s b on a.nation = b.nation and b.ano = a.ano + 3")
def j15(spark, d):
    s = series(spark, d)
    b = s.select(F.col("nation"), (F.col("ano") - 3).alias("ano"), F.col("v").alias("v1"))
    return s.join(b, ["nation", "ano"]).select("nation", F.col("ano").alias("t0"), (F.col("ano") + 3).alias("t1"), F.round(F.col("v1") / F.col("v"), 6).alias("razao"))


@query("s14_upsert", "select c_custkey, c_acctbal * 2 c_acctbal from customer where c_custkey % 3 = 0 union all select c_custkey, c_acctbal from customer where c_custkey % 3 <> 0")
def s14(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    return J.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_custkey"])


@query("s14_stored_upsert", "select c_custkey, case when c_nationkey in (3, 8) and c_custkey % 2 = 0 then c_acctbal * 2 else c_acctbal end c_acctbal, c_nationkey, case when c_nationkey in (3, 8) then 2 else 1 end versao from customer union all select -n_nationkey - 1, 0, n_nationkey, 2 from nation where n_nationkey in (3, 8)")
def s14b(spark, d):
    """A stored table whose rows of two nations are upserted: files of the others stay, and each row tells the version of its file."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey")
    table = V.create(c, V.unused(spark), "c_nationkey")
    news = c.where("c_nationkey in (3, 8) and c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    added = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey in (3, 8)").select((-F.col("n_nationkey") - 1).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"), F.col("n_nationkey").alias("c_nationkey"))
    V.upsert(spark, table, news.unionByName(added), ["c_custkey"])
    return V.read(spark, table, version="versao").select("c_custkey", "c_acctbal", "c_nationkey", "versao")


@query("o06_recomputed_years", _SERIES + "select nation, ano, case when ano in (1995, 1997) then n * 10 else n end n, case when ano in (1995, 1997) then 2 else 1 end versao from s")
def o06b(spark, d):
    """Two years of a stored series are computed anew and replaced; the files of the other years are not read or written."""
    s = series(spark, d).select("nation", "ano", "n")
    table = V.create(s, V.unused(spark), "ano")
    V.replace(spark, table, s.where("ano in (1995, 1997)").withColumn("n", F.col("n") * 10))
    return V.read(spark, table, version="versao").select("nation", "ano", "n", "versao")


@query("o01_custom_order", WITH + "select segmento, count(*) n, coalesce(list_position(['BUILDING','MACHINERY'], segmento), 99)::int posicao from persons group by all")
def o01(spark, d):
    order = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "segmento string, posicao int")
    out = persons(spark, d).groupBy("segmento").agg(F.count("*").alias("n")).join(F.broadcast(order), "segmento", "left")
    return out.withColumn("posicao", F.coalesce("posicao", F.lit(99))).orderBy("posicao", "segmento")


@query("o04_set_difference", "select c_custkey k from customer except select o_custkey from orders where o_totalprice > 300000")
def o04(spark, d):
    c, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_totalprice > 300000").select("o_custkey"))
