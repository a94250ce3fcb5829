"""Estimates, their standard errors and disclosure control."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import disclosure as D
from ..operators import estimate as E
from ..operators import quantiles as Q
from ..sources.storage import stored
from .fixtures import WITH, dwellings, persons
from .recoding import TYPED, typed
from .registry import query

_BOOT = f""", hh as (select controle, ap, row_number() over (partition by ap order by md5(controle::varchar), controle) - 1 r, count(*) over (partition by ap) k from dwellings),
 dr as (select ap, k, r, unnest(range({E.REPLICATES})) b from hh where r > 0),
 cn as (select ap, b, (('0x' || substr(md5('1|' || ap || '|' || b || '|' || r), 1, 15))::bigint % k) r, count(*) c from dr group by all),
 w as (select controle, b, c * k / (k - 1)::double m from hh join cn using (ap, r) union all select controle, unnest(range({E.REPLICATES})) b, 1.0 from hh where k = 1) """


def weights(spark, d):
    return E.bootstrap_draws(dwellings(spark, d), "controle", "ap")


@query("a02_total", WITH + "select censo, sum(peso) total from persons where situacao = 'urbana' group by censo")
def a02(spark, d):
    return persons(spark, d).where("situacao = 'urbana'").groupBy("censo").agg(F.sum("peso").alias("total"))


@query("a06_bootstrap_weights", WITH + _BOOT + "select controle, b::int b, round(m, 6) m from w")
def a06(spark, d):
    return E.bootstrap_weights(dwellings(spark, d), "controle", "ap").select("controle", "b", F.round("m", 6).alias("m"))


def _se(cell, x, den, where="true"):
    value = "sum(x)" if den is None else "case when sum(d) > 0 then sum(x) / sum(d) end"
    valuem = "sum(x * m)" if den is None else "case when sum(d * m) > 0 then sum(x * m) / sum(d * m) end"
    return f""", s as (select {cell}, controle, sum(peso * ({x})) x, sum(peso * ({den or 0})) d from persons where {where} group by all),
 p as (select {cell}, {value} as value from s group by {cell}), r as (select {cell}, b, {valuem} v from s join w using (controle) group by {cell}, b),
 q as (select {cell}, stddev_samp(v) se from r group by {cell}) select {cell}, round(value, 6) as value, round(se, 6) se from p left join q using ({cell})"""


def _round(df):
    return df.withColumns({"value": F.round("value", 6), "se": F.round("se", 6)})


@query("a07_total_se", WITH + _BOOT + _se("censo", "coalesce(idade >= 60, false)::int", None))
def a07(spark, d):
    return _round(E.total(persons(spark, d), weights(spark, d), ["censo"], "controle", "peso", F.col("idade") >= 60))


@query("a03_proportion", WITH + _BOOT + _se("censo", "(coalesce(idade >= 60, false) and coalesce(situacao = 'urbana', false))::int", "coalesce(situacao = 'urbana', false)::int"))
def a03(spark, d):
    return _round(E.proportion(persons(spark, d), weights(spark, d), ["censo"], "controle", "peso", F.col("idade") >= 60, F.col("situacao") == "urbana"))


@query("a04_mean", WITH + _BOOT + _se("segmento", "renda", "1", "renda is not null"))
def a04(spark, d):
    return _round(E.mean(persons(spark, d), weights(spark, d), ["segmento"], "controle", "peso", "renda"))


@query("a05_weighted_median", WITH + ", c as (select segmento, renda, sum(peso) over (partition by segmento order by renda) c, sum(peso) over (partition by segmento) t from persons where renda is not null) select segmento, round(min(renda), 6) as value from c where c >= 0.5 * t group by segmento")
def a05(spark, d):
    return E.weighted_median(persons(spark, d), ["segmento"], "peso", "renda").withColumn("value", F.round("value", 6))


@query("a07_median_se", WITH + _BOOT + """, j as (select segmento, b, renda, sum(peso * m) w from persons join w using (controle) where renda is not null and b < 60 group by all),
 c as (select segmento, b, renda, sum(w) over (partition by segmento, b order by renda) c, sum(w) over (partition by segmento, b) t from j),
 v as (select segmento, b, min(renda) v from c where c >= 0.5 * t - 1e-9 * t group by all) select segmento, round(stddev_samp(v), 4) se from v group by segmento""")
def a07b(spark, d):
    return E.median_with_se(persons(spark, d), weights(spark, d), ["segmento"], "controle", "peso", "renda").select("segmento", F.round("se", 4).alias("se"))


@query("a08_sample_counts", WITH + "select censo, segmento, count(*) n, count(distinct controle) n_dom from persons group by all")
def a08(spark, d):
    return E.sample_counts(persons(spark, d), ["censo", "segmento"], "controle")


@query("a09_persons_in_dwellings", WITH + "select tipo, count(pessoa) pessoas, count(distinct d.controle) domicilios from dwellings d left join persons p on p.controle = d.controle group by tipo")
def a09(spark, d):
    per = persons(spark, d).groupBy("controle").agg(F.count("*").alias("n"))
    return dwellings(spark, d).join(per, "controle", "left").groupBy("tipo").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pessoas"), F.count("*").alias("domicilios"))


_LONG = WITH + ", u as (select censo, peso, controle, unnest([{'dim': 'segmento', 'cat': segmento}, {'dim': 'prioridade', 'cat': prioridade}, {'dim': 'situacao', 'cat': situacao}], recursive := true) from persons), l as (select * from u where cat is not null) "


@query("a11_one_dimension", _LONG + "select censo, dim, cat, sum(peso) valor, round(100 * sum(peso) / sum(sum(peso)) over (partition by censo, dim), 6) pct from l group by censo, dim, cat")
def a11(spark, d):
    from pyspark.sql.window import Window

    cells = E.unpivot(persons(spark, d), ["segmento", "prioridade", "situacao"], ["censo", "peso"]).groupBy("censo", "dim", "cat").agg(F.sum("peso").alias("valor"))
    return cells.withColumn("pct", F.round(100 * F.col("valor") / F.sum("valor").over(Window.partitionBy("censo", "dim")), 6))


@query("a12_two_dimensions", WITH + "select censo, segmento, status, sum(peso) valor, round(100 * sum(peso) / sum(sum(peso)) over (partition by censo, segmento), 6) pct from persons group by censo, segmento, status")
def a12(spark, d):
    from pyspark.sql.window import Window

    cells = persons(spark, d).groupBy("censo", "segmento", "status").agg(F.sum("peso").alias("valor"))
    return cells.withColumn("pct", F.round(100 * F.col("valor") / F.sum("valor").over(Window.partitionBy("censo", "segmento")), 6))


@query("a15_open_list", WITH + ", t as (select uf_atual from persons where uf_atual is not null group by 1 order by count(*) desc, uf_atual limit 10) select case when uf_atual in (from t) then uf_atual else 'outros' end uf, count(*) n from persons where uf_atual is not null group by 1")
def a15(spark, d):
    out = E.top_categories(persons(spark, d).where("uf_atual is not null").select(F.col("uf_atual").alias("uf")), "uf", 10)
    return out.groupBy("uf").agg(F.count("*").alias("n"))


@query("a18_conditional_counts", "select event_type, count(*) n, count(*) filter (value < 50) low, min(value) least, round(median(value), 6) mid from events group by event_type")
def a18(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    facts = ev.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("low"), F.min("value").alias("least"))
    return Q.beside(facts, ["event_type"], Q.quantiles(ev, ["event_type"], "value", {"mid": 0.5})).withColumn("mid", F.round("mid", 6))


@query("a19_pivot", WITH + "select censo, sum(peso) filter (status = 'F') f, sum(peso) filter (status = 'O') o, sum(peso) filter (status = 'P') p from persons group by censo")
def a19(spark, d):
    out = persons(spark, d).groupBy("censo").pivot("status", ["F", "O", "P"]).agg(F.sum("peso"))
    return out.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("a20_weighted_means", WITH + ", u as (select segmento, peso, unnest([{'k': 'idade', 'v': idade::double}, {'k': 'renda', 'v': renda}], recursive := true) from persons) select segmento, k, round(sum(peso * v) / sum(peso) filter (v is not null), 6) media, round(median(v), 6) mediana from u group by all")
def a20(spark, d):
    long = persons(spark, d).selectExpr("segmento", "peso", "stack(2, 'idade', cast(idade as double), 'renda', renda) as (k, v)")
    mean = F.sum(F.col("peso") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), F.col("peso")))
    means = long.groupBy("segmento", "k").agg(F.round(mean, 6).alias("media"))
    return Q.beside(means, ["segmento", "k"], Q.quantiles(long, ["segmento", "k"], "v", {"mediana": 0.5})).withColumn("mediana", F.round("mediana", 6))


@query("a22_missing_years", WITH + "select y ano from range(1990, 2004) t(y) where y not in (select ano from persons)")
def a22(spark, d):
    spine = spark.range(1990, 2004).select(F.col("id").alias("ano"))
    return spine.join(persons(spark, d).select(F.col("ano").cast("long")).distinct(), "ano", "left_anti")


@query("f07_precision", WITH + _BOOT + _se("uf_atual", "1", None).replace("select uf_atual, round(value, 6) as value, round(se, 6) se from p", ", z as (select uf_atual, round_even(value / 10, 0) * 10 v, round_even(se / 10, 0) * 10 e from p").replace("left join q using (uf_atual)", "left join q using (uf_atual)) select uf_atual, v valor, e ep, round(case when v > 0 then 100 * e / v end, 4) cv, case when v is null or v <= 0 then 'sem_estimativa' when 100 * e / v <= 15 then 'boa' when 100 * e / v <= 30 then 'cautela' else 'baixa' end classe from z"))
def f07(spark, d):
    est = E.total(persons(spark, d), weights(spark, d), ["uf_atual"], "controle", "peso")
    cv = F.when(F.col("valor") > 0, 100 * F.col("ep") / F.col("valor"))
    out = est.select("uf_atual", R.round_to(F.col("value")).alias("valor"), R.round_to(F.col("se")).alias("ep"))
    return out.withColumn("cv", cv).withColumn("classe", R.precision_class(F.col("cv"))).withColumn("cv", F.round("cv", 4))


@query("f09_sample_bands", WITH + "select ap, ano, case when n < 5 then '<5' when n <= 9 then '5-9' when n <= 19 then '10-19' when n <= 49 then '20-49' when n <= 99 then '50-99' when n <= 499 then '100-499' else '>=500' end faixa from (select ap, ano, count(*) n from persons group by all)")
def f09(spark, d):
    return persons(spark, d).groupBy("ap", "ano").agg(F.count("*").alias("n")).select("ap", "ano", R.sample_band(F.col("n")).alias("faixa"))


_CELLS = WITH + ", c as (select censo, ap, status, count(*) n, count(distinct controle) n_dom from persons group by all) "


@query("d01_threshold", _CELLS + "select *, case when censo = 2022 then n >= 20 and n_dom >= 10 else n >= 10 and n_dom >= 5 end publishable from c")
def d01(spark, d):
    cells = persons(spark, d).groupBy("censo", "ap", "status").agg(F.count("*").alias("n"), F.countDistinct("controle").alias("n_dom"))
    return D.threshold(cells)


SHARES = ["F", "O", "P"]
_GROUP = ["censo", "ap", "ano"]
# All unions of the three categories as masks; a fold over at most three steps, one join a step.
_MASKS = WITH + """, base as (select censo, ap, ano, status, controle, case status when 'F' then 1 when 'O' then 2 else 4 end bit from persons where status in ('F', 'O', 'P')),
 masks as (select m from range(1, 8) t(m)),
 u as (select censo, ap, ano, m, count(*) n, count(distinct controle) h, count(distinct status) k from base join masks on bit & m <> 0 group by all),
 ok as (select *, n >= case when censo = 2022 then 20 else 10 end and h >= case when censo = 2022 then 10 else 5 end good from u),
 one as (select censo, ap, ano, m bit, n, good from ok where m in (1, 2, 4)),
 g as (select censo, ap, ano, sum(bit)::int present, coalesce(sum(bit) filter (not good), 0)::int s from one group by all),
 """ + "".join(
    f"""s{i + 1} as (select g.censo, g.ap, g.ano, present, case when s = 0 or (bit_count(s) >= 2 and ok.good) then s
      else s | coalesce((select bit from one o where o.censo = g.censo and o.ap = g.ap and o.ano = g.ano and o.bit & g.s = 0 order by o.n, bit limit 1), 0) end::int s
      from {'g' if i == 0 else f's{i}'} g left join ok on ok.censo = g.censo and ok.ap = g.ap and ok.ano = g.ano and ok.m = g.s), """
    for i in range(3)
) + """ f as (select f.censo, f.ap, f.ano, present, case when s = 0 or (bit_count(s) >= 2 and coalesce(ok.good, false)) then s else present end s
        from s3 f left join ok on ok.censo = f.censo and ok.ap = f.ap and ok.ano = f.ano and ok.m = f.s),
 shown as (select censo, ap, ano, s, unnest(case when s = present then [] else [x for x in [1, 2, 4] if x & present <> 0 and x & s = 0] || case when s = 0 then [] else [s] end end) m from f),
 cells as (select x.censo, x.ap, x.ano, case when bit_count(x.m) = 1 then case x.m when 1 then 'F' when 2 then 'O' else 'P' end
             else 'outros:' || array_to_string([c[1] for c in [['F', '1'], ['O', '2'], ['P', '4']] if c[2]::int & x.m & present <> 0], '+') end as label, ok.n, ok.h n_dom, bit_count(x.s)::bigint n_suppressed
           from shown x join f using (censo, ap, ano) join ok on ok.censo = x.censo and ok.ap = x.ap and ok.ano = x.ano and ok.m = x.m) """


def _statuses(spark, d):
    return D.patterns(persons(spark, d), _GROUP, "status", "controle", SHARES)


@query("d08_suppression", _MASKS + "select * from cells")
def d08(spark, d):
    return D.suppress(_statuses(spark, d), _GROUP, SHARES, F.col("censo")).drop("members")


@query("d12_recount", _MASKS + """select c.censo, c.ap, c.ano, label, n, n_dom, n_suppressed, count(*) again_n, count(distinct controle) again_dom, count(distinct status) present, true agrees
 from cells c join base b on b.censo = c.censo and b.ap = c.ap and b.ano = c.ano and list_contains(string_split(replace(label, 'outros:', ''), '+'), status) group by all""")
def d12(spark, d):
    return D.recount(d08(spark, d), persons(spark, d).select(*_GROUP, "status", "controle"), _GROUP, "status", "controle")


@query("d13_fused_members", _MASKS + """select c.censo, c.ap, c.ano, label, count(distinct status) present from cells c join base b on b.censo = c.censo and b.ap = c.ap and b.ano = c.ano
 and list_contains(string_split(replace(label, 'outros:', ''), '+'), status) where label like 'outros%' group by all""")
def d13(spark, d):
    return d12(spark, d).where("label like 'outros%'").select(*_GROUP, "label", "present")


@query("d11_suppression_audit", _MASKS + """, o as (select censo, ap, ano, count(*) cells, count(*) filter (label like 'outros%') fused, max(n_suppressed) hidden from cells group by all)
 select g.censo, count(*) as groups, count(*) filter (cells is null) withheld, coalesce(sum(cells), 0)::bigint cells, coalesce(sum(fused), 0)::bigint fused,
 sum(coalesce(hidden, bit_count(present)))::bigint suppressed from g left join o using (censo, ap, ano) group by g.censo""")
def d11(spark, d):
    table = _statuses(spark, d)
    return D.suppression_audit(D.suppress(table, _GROUP, SHARES, F.col("censo")), table, _GROUP, ["censo"])


@query("d07_structural_zeros", WITH + """select censo, ap, ano, string_agg(distinct status, '+' order by status) presentes, 3 - count(distinct status) zeros from persons where status in ('F', 'O', 'P') group by all""")
def d07(spark, d):
    names = F.expr("transform(filter(members, e -> e.n > 0), e -> case e.bit when 1 then 'F' when 2 then 'O' else 'P' end)")
    out = _statuses(spark, d).withColumn("p", F.array_sort(names))
    return out.select(*_GROUP, F.array_join("p", "+").alias("presentes"), (3 - F.size("p")).cast("long").alias("zeros"))


@query("d06_differencing", WITH + """, c as (select censo, ap, status, count(*) filter (situacao = 'urbana') sede, count(*) filter (situacao is distinct from 'urbana') rest_n,
 count(distinct controle) filter (situacao is distinct from 'urbana') rest_dom from persons group by all)
 select *, rest_n = 0 or (rest_n >= case when censo = 2022 then 20 else 10 end and rest_dom >= case when censo = 2022 then 10 else 5 end) safe from c""")
def d06(spark, d):
    away = ~F.col("situacao").eqNullSafe("urbana")
    cells = persons(spark, d).groupBy("censo", "ap", "status").agg(
        F.count_if(~away).alias("sede"), F.count_if(away).alias("rest_n"), F.countDistinct(F.when(away, F.col("controle"))).alias("rest_dom")
    )
    return D.differencing(cells, F.col("censo"))


@query("d18_wide_suppression", WITH + "select ap, ano, n, case when n >= 40 then pop end pop, n < 40 suppressed from (select ap, ano, count(*) n, sum(peso) pop from persons group by all)")
def d18(spark, d):
    wide = persons(spark, d).groupBy("ap", "ano").agg(F.count("*").alias("n"), F.sum("peso").alias("pop"))
    return D.suppress_wide(wide, "n", ["pop"], 40)


_AUDIT = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in D.AUDIT_RULES.items())


@query("d19_audit", f"""with h as (select doc_id, text, r rule, unnest(list_distinct(regexp_extract_all(text, p))) as match from documents, (values {_AUDIT}) t(r, p))
 select doc_id, rule, match, substr(text, greatest(instr(text, match) - {D.SNIPPET}, 1), instr(text, match) - greatest(instr(text, match) - {D.SNIPPET}, 1) + length(match) + {D.SNIPPET}) snippet
 from h where not (rule = 'email' and lower(split_part(match, '@', 2)) in {D.ALLOWED_DOMAINS})""")
def d19(spark, d):
    return D.audit_text(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


@query("slice_migrant_sectors", TYPED + _BOOT + """, t as (select *, case when tipo is null then null when tipo = 'nao_migrante' then 'nao' else 'sim' end mig from typed),
 b0 as (select mig, controle, sum(peso) d from t where mig is not null group by all), n0 as (select mig, segmento, controle, sum(peso) x, count(*) n from t where mig is not null group by all),
 v as (select mig, segmento, sum(x) x, sum(n)::bigint n, count(*) n_dom from n0 group by all), vd as (select mig, sum(d) d from b0 group by all),
 r as (select n0.mig, segmento, b, sum(x * m) x from n0 join w using (controle) group by all), rd as (select mig, b, sum(d * m) d from b0 join w using (controle) group by all),
 s as (select mig, segmento, stddev_samp(coalesce(x, 0) / d) se from (select mig, segmento, b, d from rd join (select distinct mig, segmento from v) using (mig)) left join r using (mig, segmento, b) group by all)
 select mig, segmento, round(100 * x / d, 4) pct, round(100 * se, 4) ep, n, n_dom from v join vd using (mig) join s using (mig, segmento) where n >= 20 and n_dom >= 10""")
def flagship(spark, d):
    """Share of each segment among migrants and others, with bootstrap errors; only publishable cells."""
    t = typed(spark, d).where("tipo is not null").withColumn("mig", F.when(F.col("tipo") == "nao_migrante", "nao").otherwise("sim"))
    parts = stored(t.groupBy("mig", "segmento", "controle").agg(F.sum("peso").alias("x"), F.count("*").alias("n")))
    cells = parts.groupBy("mig", "segmento").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.count("*").alias("n_dom"))
    sums = E.replicate_sums(parts.select("mig", "segmento", "controle", F.col("x").alias("_x"), F.lit(0.0).alias("_d")), weights(spark, d), ["mig", "segmento"], "controle")
    rx = stored(sums.where("b >= 0 and _x is not null").select("mig", "segmento", "b", F.col("_x").alias("x")))
    rb = rx.groupBy("mig", "b").agg(F.sum("x").alias("d"))  # a base is all its segments
    grid = rb.join(cells.select("mig", "segmento"), "mig").join(rx, ["mig", "segmento", "b"], "left")
    se = grid.groupBy("mig", "segmento").agg(F.stddev_samp(F.coalesce("x", F.lit(0.0)) / F.col("d")).alias("se"))
    out = cells.join(cells.groupBy("mig").agg(F.sum("x").alias("d")), "mig").join(se, ["mig", "segmento"])
    return out.where("n >= 20 and n_dom >= 10").select("mig", "segmento", F.round(100 * F.col("x") / F.col("d"), 4).alias("pct"), F.round(100 * F.col("se"), 4).alias("ep"), "n", "n_dom")
