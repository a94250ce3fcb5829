"""Profile variables, set operations and ordered jobs over the persons and dwellings seen in the driver's tables."""

from pyspark.sql import functions as F

from ..functions import profile as P
from ..functions import recode as R
from ..operators import series as S
from .fixtures import WITH, dwellings, persons
from .recoding import TYPED, typed
from .registry import query

c = F.col
_ASKED = {"instrucao": {1991: "anos_estudo", 2000: "anos_estudo + 1", 2010: "cast(raca_cod as int)", 2022: "idade"}}


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def case(column, mapping):
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


@query("p02_concepts", WITH + "select pessoa, (case censo when 1991 then anos_estudo when 2000 then anos_estudo + 1 when 2010 then raca_cod::int else idade end)::int instrucao from persons")
def p02(spark, d):
    return persons(spark, d).select("pessoa", P.by_wave(_ASKED, "instrucao", "censo", [1991, 2000, 2010, 2022]))


_ARRIVAL = "case when ano + 15 - tempo_moradia <= 2001 then '1995_2001' when ano + 15 - tempo_moradia <= 2004 then '2002_2004' when ano + 15 - tempo_moradia <= 2012 then '2005_2012' when ano + 15 - tempo_moradia <= 2016 then '2013_2016' when ano + 15 - tempo_moradia <= 2022 then '2017_2022' end"


@query("p12_arrival_period", WITH + f"select pessoa, {_ARRIVAL} periodo from persons")
def p12(spark, d):
    return persons(spark, d).select("pessoa", P.arrival_period(c("ano") + 15 - c("tempo_moradia")).alias("periodo"))


@query("p08_income_1991", WITH + f"select pessoa, {case('(anos_estudo)::varchar', P.INCOME_1991)} faixa from persons")
def p08(spark, d):
    return persons(spark, d).select("pessoa", R.recode(c("anos_estudo").cast("string"), P.INCOME_1991).alias("faixa"))


_STATES = {f"{i:02d}": s for i, s in enumerate(sorted(P.REGIONS), 1)}


@query("p14_state_codes", WITH + f"select pessoa, {case('uf_origem', _STATES)} uf from persons")
def p14(spark, d):
    return persons(spark, d).select("pessoa", P.standard_state(c("uf_origem")).alias("uf"))


@query("p16_origin_region", TYPED + f"select pessoa, case tipo when 'intraestadual' then 'mesma_uf' when 'interestadual' then {case('uf_origem', P.REGIONS)} when 'internacional' then 'exterior' end regiao from typed")
def p16(spark, d):
    return typed(spark, d).select("pessoa", P.origin_region(c("tipo"), c("uf_origem")).alias("regiao"))


@query("p17_birthplace", WITH + "select pessoa, case when migracao_cod = '1' then 'municipio' when migracao_cod = '3' then 'exterior' when migracao_cod = '2' and uf_origem = uf_atual then 'mesma_uf' when migracao_cod = '2' and uf_origem <> '' then 'outra_uf' end nat from persons")
def p17(spark, d):
    return persons(spark, d).select("pessoa", P.birthplace(c("migracao_cod"), c("uf_origem"), c("uf_atual")).alias("nat"))


_UFN = case("lpad(cast(cast(uf_origem as int) + 5 as varchar), 2, '0')", {k: k for k in P.REGIONS})


@query("p17_birthplace_waves", WITH + f""", q as (select *, {_UFN} u, coalesce(uf_origem, '') k from persons)
 select pessoa, case when sexo_cod in ('1', '2') then 'municipio' when sexo_cod <> '0' then null when u is null and trim(k) <> '' then 'exterior' when u <> uf_atual then 'outra_uf' when raca_cod in ('1', '2') or u = uf_atual then 'mesma_uf' end n2010,
 case when nunca_mudou = '2' or raca_cod = '1' then 'municipio' when raca_cod = '2' and trim(k) = '' then 'mesma_uf' when raca_cod = '2' and u <> '15' then 'outra_uf' when raca_cod = '2' and u is null then 'exterior' end n2000,
 case when raca_cod in ('1', '2') then 'municipio' when raca_cod = '3' and anos_estudo >= 15 then 'exterior' when raca_cod = '3' and u = '15' then 'mesma_uf' when raca_cod = '3' and u is not null then 'outra_uf' end n1991 from q""".replace("nunca_mudou = '2' or raca_cod = '1' then 'municipio'", "nunca_mudou = '2' and raca_cod = '2' and trim(k) <> '' and u is null then 'exterior' when nunca_mudou = '2' and raca_cod = '2' and u <> '15' then 'outra_uf' when nunca_mudou = '2' or raca_cod = '1' then 'municipio'"))
def p17b(spark, d):
    known = F.lpad((c("uf_origem").cast("int") + 5).cast("string"), 2, "0")
    state, code = F.when(known.isin(list(P.REGIONS)), known), F.coalesce("uf_origem", F.lit(""))
    born = F.when(c("sexo_cod") == "0", "3").otherwise(c("sexo_cod"))
    abroad = F.when(c("anos_estudo") >= 15, 30)
    return persons(spark, d).select(
        "pessoa", P.birthplace_2010(born, c("raca_cod"), code, state, c("uf_atual")).alias("n2010"),
        P.birthplace_2000(F.when(c("nunca_mudou") == "2", "1"), c("raca_cod"), code, state, "15").alias("n2000"), P.birthplace_1991(c("raca_cod").cast("int"), abroad, state, "15").alias("n1991"),
    )


@query("p18_tenure_waves", WITH + "select pessoa, case when nunca_mudou <> '2' then 2022 - tempo_moradia end a2022, case when sexo_cod <> '1' then 2010 - tempo_moradia end a2010, case when sexo_cod = '2' then 2000 - tempo_moradia end a2000, case when raca_cod <> '1' then 1991 - tempo_moradia end a1991 from persons")
def p18b(spark, d):
    moved = {2022: c("nunca_mudou") != "2", 2010: c("sexo_cod") != "1", 2000: c("sexo_cod") == "2", 1991: c("raca_cod") != "1"}
    return persons(spark, d).select("pessoa", *[P.arrival_year(w, c("tempo_moradia"), m).alias(f"a{w}") for w, m in moved.items()])


@query("p18_tenure", WITH + "select pessoa, case when nunca_mudou = '2' then idade when migracao_cod <> '1' then tempo_moradia end tempo, case when migracao_cod <> '1' then ano - tempo_moradia end chegada from persons")
def p18(spark, d):
    asked = c("migracao_cod") != "1"
    return persons(spark, d).select("pessoa", P.tenure(c("tempo_moradia"), c("idade"), asked, c("nunca_mudou") == "2").alias("tempo"), F.when(asked, c("ano") - c("tempo_moradia")).alias("chegada"))


@query("p19_formal", WITH + "select pessoa, situacao = 'urbana' formal from persons")
def p19(spark, d):
    return persons(spark, d).select("pessoa", P.among(c("situacao"), ["urbana"]).alias("formal"))


@query("p20_skip_implied", WITH + "select pessoa, case when idade < 10 then null when raca_cod = '2' then false when status = 'O' then true when status = 'F' then false end ocupado from persons")
def p20(spark, d):
    answered = R.tristate(c("status"), ["O"], ["O", "F"])
    return persons(spark, d).select("pessoa", P.implied_false(answered, c("raca_cod") == "2", c("idade") < 10).alias("ocupado"))


@query("p22_implied_decimal", WITH + "select controle, round(controle / 10.0, 4)::double v from dwellings")
def p22(spark, d):
    return dwellings(spark, d).select("controle", F.round(P.implied_decimal(c("controle"), 1), 4).alias("v"))


@query("p24_household_id", "select conv_id, turn, sum((turn = 0)::int) over (order by conv_id, turn)::bigint controle from conversations")
def p24(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn")
    return S.running_group(rows, ["conv_id", "turn"], c("turn") == 0, "controle")


@query("p25_composite_code", WITH + "select pessoa, case when uf_atual = '05' and censo = 1991 then '15X' else '15' || lpad(uf_atual, 4, '0') end cod from persons")
def p25(spark, d):
    moved = (c("uf_atual") == "05") & (c("censo") == 1991)
    return persons(spark, d).select("pessoa", F.when(moved, "15X").otherwise(F.concat(F.lit("15"), F.lpad("uf_atual", 4, "0"))).alias("cod"))


@query("p29_industry", WITH + "select pessoa, divisao in ('05', '07', '08', '09') sem_petroleo, divisao = '06' petroleo from persons")
def p29(spark, d):
    return persons(spark, d).select("pessoa", P.among(c("divisao"), ["05", "07", "08", "09"]).alias("sem_petroleo"), P.among(c("divisao"), ["06"]).alias("petroleo"))


_LABELS = {"urbana": "Urbana", "rural": "Rural"}


@query("p30_fused_labels", WITH + "select pessoa, case when sexo_cod = '0' then 'Outros (' || coalesce(case situacao when 'urbana' then 'Urbana' when 'rural' then 'Rural' end, 'x') || ', ' || segmento || ')' else coalesce(case situacao when 'urbana' then 'Urbana' when 'rural' then 'Rural' end, '') end rotulo from persons")
def p30(spark, d):
    fused = F.concat(F.lit("outros:"), F.coalesce("situacao", F.lit("x")), F.lit("+"), "segmento")
    return persons(spark, d).select("pessoa", P.fused_label(F.when(c("sexo_cod") == "0", fused).otherwise(c("situacao")), _LABELS).alias("rotulo"))


@query("p31_cube_filter", WITH + "select censo, segmento, count(*) n from persons where censo in (1991, 2022) and situacao is null and status = 'F' group by all")
def p31(spark, d):
    wanted = {"censo": [1991, 2022], "situacao": None, "status": "F"}
    test = F.lit(True)
    for column, value in wanted.items():
        test &= c(column).isNull() if value is None else c(column).isin(*value) if isinstance(value, list) else c(column) == value
    return persons(spark, d).where(test).groupBy("censo", "segmento").agg(F.count("*").alias("n"))


@query("p32_season", "select event_id, case when month(ts) between 6 and 9 then 'seca' when month(ts) between 1 and 4 then 'chuva' else 'transicao' end estacao, nullif(regexp_extract(event_type, '^([a-z]+)', 1), '') tipo from events")
def p32(spark, d):
    month = F.month("ts")
    season = F.when(month.between(6, 9), "seca").when(month.between(1, 4), "chuva").otherwise("transicao")
    return read(spark, d, "events").select("event_id", season.alias("estacao"), F.nullif(F.regexp_extract("event_type", "^([a-z]+)", 1), F.lit("")).alias("tipo"))


@query("p33_first_non_empty", "select event_id, coalesce(nullif(trim(props->>'$.cloud'), ''), nullif(trim(props->>'$.k'), ''), event_type) v from events")
def p33(spark, d):
    found = P.first_non_empty(F.get_json_object("props", "$.cloud"), F.get_json_object("props", "$.k"), c("event_type"))
    return read(spark, d, "events").select("event_id", found.alias("v"))


@query("p35_sex_ratio", WITH + "select segmento, round(100.0 * count(*) filter (sexo_cod = '1') / nullif(count(*) filter (sexo_cod = '2'), 0), 6) razao, round(100.0 * count(*) filter (raca_cod in ('2', '4')) / nullif(count(*) filter (raca_cod in ('1', '2', '3', '4', '5')), 0), 6) pretos_pardos from persons group by segmento")
def p35(spark, d):
    n = lambda column, *codes: F.count_if(c(column).isin(*codes))
    out = persons(spark, d).groupBy("segmento").agg(n("sexo_cod", "1").alias("m"), n("sexo_cod", "2").alias("f"), n("raca_cod", "2", "4").alias("p"), n("raca_cod", "1", "2", "3", "4", "5").alias("b"))
    return out.select("segmento", F.round(F.try_divide(100.0 * c("m"), c("f")), 6).alias("razao"), F.round(F.try_divide(100.0 * c("p"), c("b")), 6).alias("pretos_pardos"))


@query("p36_any_prefix", WITH + "select pessoa from persons where coalesce(starts_with(uf_origem, '1'), false) or starts_with(divisao, '0')")
def p36(spark, d):
    return persons(spark, d).where(P.any_prefix([c("uf_origem"), c("divisao")], "1") | P.any_prefix([c("divisao")], "0")).select("pessoa")


@query("j02_left_enrich", "select o_orderkey k, n_name pais, r_name regiao from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j02(spark, d):
    o, u, n, r = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    out = o.join(u, c("o_custkey") == c("c_custkey"), "left").join(n, c("c_nationkey") == c("n_nationkey"), "left").join(r, c("n_regionkey") == c("r_regionkey"), "left")
    return out.select(c("o_orderkey").alias("k"), c("n_name").alias("pais"), c("r_name").alias("regiao"))


_BOTH = WITH + ", a as (select segmento, ano, count(*) n, sum(peso) peso from persons where status = 'F' group by all), b as (select segmento, ano, count(*) n, sum(peso) peso from persons where status = 'P' group by all) "


def _sides(spark, d):
    p = persons(spark, d)
    return [p.where(c("status") == s).groupBy("segmento", "ano").agg(F.count("*").alias("n"), F.sum("peso").alias("peso")) for s in "FP"]


@query("j03_suffixes", _BOTH + "select segmento, ano, a.n n_x, a.peso peso_x, b.n n_y, b.peso peso_y from a join b using (segmento, ano)")
def j03(spark, d):
    a, b = _sides(spark, d)
    own = {"n": "n_x", "peso": "peso_x"}
    return a.withColumnsRenamed(own).join(b.withColumnsRenamed({k: k + "_y" for k in own}), ["segmento", "ano"])


@query("j04_full_outer", _BOTH + "select segmento, ano, a.n n_x, b.n n_y from a full join b using (segmento, ano)")
def j04(spark, d):
    a, b = _sides(spark, d)
    return a.select("segmento", "ano", c("n").alias("n_x")).join(b.select("segmento", "ano", c("n").alias("n_y")), ["segmento", "ano"], "full_outer")


@query("j05_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def j05(spark, d):
    keys = read(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left_semi")


@query("j06_anti", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def j06(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j09_crosswalk", WITH + ", x as (select n_nationkey::bigint ap, r_name area from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA') select area, count(*) n, string_agg(distinct lpad(d.ap::varchar, 2, '0'), ',' order by lpad(d.ap::varchar, 2, '0')) membros from dwellings d left join x on d.ap = x.ap group by area")
def j09(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    walk = n.join(r, c("n_regionkey") == c("r_regionkey")).where("r_name <> 'ASIA'").select(c("n_nationkey").cast("long").alias("ap"), c("r_name").alias("area"))
    units = dwellings(spark, d).groupBy("ap").agg(F.count("*").alias("n")).join(walk, "ap", "left")
    members = F.array_join(F.sort_array(F.collect_set(F.lpad(c("ap").cast("string"), 2, "0"))), ",")
    return units.groupBy("area").agg(F.sum("n").alias("n"), members.alias("membros"))


@query("j13_scaffold", WITH + ", g as (select distinct segmento from persons), k as (select distinct censo from persons), s as (select distinct status from persons) select g.segmento, k.censo, s.status, count(p.pessoa) n from g cross join k cross join s left join persons p on p.segmento = g.segmento and p.censo = k.censo and p.status = s.status and p.situacao is null group by all")
def j13(spark, d):
    p = persons(spark, d)
    keys = ["segmento", "censo", "status"]
    axes = [p.select(k).distinct() for k in keys]
    frame = axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2]))  # three closed lists of categories
    found = p.where("situacao is null").groupBy(*keys).agg(F.count("*").alias("n"))
    return frame.join(found, keys, "left").fillna(0, ["n"])


@query("w11_quantile", WITH + "select segmento, min(renda) renda from (select segmento, renda, sum(peso) over (partition by segmento order by renda) / sum(peso) over (partition by segmento) s from persons where renda is not null) where s >= 0.9 group by segmento")
def w11(spark, d):
    return S.quantile_row(persons(spark, d), ["segmento"], "renda", "peso", 0.9)


@query("w13_cumulative", "select l_suppkey, ano, n, sum(n) over (partition by l_suppkey order by ano)::bigint total from (select l_suppkey, year(l_shipdate)::int ano, count(*) n from lineitem group by all)")
def w13(spark, d):
    return S.cumulative_counts(read(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("ano")), ["l_suppkey"], "ano")


@query("w15_latest_known", WITH + "select controle, max(pessoa) pessoa, max_by(tempo_moradia, pessoa) tempo_moradia from persons where tempo_moradia is not null group by controle")
def w15(spark, d):
    return S.latest_known(persons(spark, d), ["controle"], "pessoa", "tempo_moradia")


@query("o05_members_subset", WITH + "select pessoa, list_has_all(['1', '2', '4'], [sexo_cod, raca_cod]) dentro from persons")
def o05(spark, d):
    members = F.split(F.concat_ws("+", "sexo_cod", "raca_cod"), r"\+")
    return persons(spark, d).select("pessoa", (F.size(F.array_except(members, F.array(*map(F.lit, "124")))) == 0).alias("dentro"))


@query("f05_inverted_index", r"select doc_id, array_to_string(list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> ''), ' ') texto from documents")
def f05(spark, d):
    # Texts are dealt by document once, so that both groupings stay where they are: words are never shuffled.
    words = read(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "").alias("w"))
    found = words.select("doc_id", F.posexplode_outer("w").alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("p"))
    entries = F.collect_list(F.when(c("w").isNotNull(), F.struct("w", "p")))
    return found.groupBy("doc_id").agg(F.map_from_entries(entries).alias("i")).select("doc_id", P.text_from_index(c("i")).alias("texto"))


@query("f06_geometric_rate", "select o_custkey, round((pow(sum(o_totalprice) filter (year(o_orderdate) = 1997) / sum(o_totalprice) filter (year(o_orderdate) = 1995), 0.5) - 1) * 100, 6) taxa from orders group by o_custkey")
def f06(spark, d):
    level = lambda y: F.sum(F.when(F.year("o_orderdate") == y, c("o_totalprice")))
    levels = read(spark, d, "orders").groupBy("o_custkey").agg(level(1995).alias("a"), level(1997).alias("b"))
    return levels.select("o_custkey", F.round(P.geometric_rate(c("a"), c("b"), F.lit(2)), 6).alias("taxa"))


@query("f15_all_terms", "select doc_id from documents where contains(lower(text), 'license') and contains(lower(text), 'the')")
def f15(spark, d):
    return read(spark, d, "documents").where(P.has_all_terms(F.lower("text"), ["license", "the"])).select("doc_id")
