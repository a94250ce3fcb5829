"""Recodes, bands, predicates and migration types over the persons and dwellings seen in the driver's tables."""

from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions.profile import REGIONS, standard_state
from ..operators import migration as M
from .fixtures import WITH, dwellings, persons
from .registry import query


def _case(column, mapping):
    return "case " + column + " " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


@query("p01_recode", WITH + f"select pessoa, {_case('sexo_cod', R.SEX)} sexo, {_case('raca_cod', R.RACE)} raca from persons")
def p01(spark, d):
    return persons(spark, d).select("pessoa", R.recode(F.col("sexo_cod"), R.SEX).alias("sexo"), R.recode(F.col("raca_cod"), R.RACE).alias("raca"))


@query("p03_tristate", WITH + "select pessoa, case when raca_cod in ('1','2') then true when raca_cod in ('3','4') then false end flag from persons")
def p03(spark, d):
    return persons(spark, d).select("pessoa", R.tristate(F.col("raca_cod"), ["1", "2"], ["1", "2", "3", "4"]).alias("flag"))


_SECTOR = "case " + " ".join(f"when divisao::int between {a} and {b} then '{s}'" for a, b, s in R.SECTORS_2010) + " else 'outras_atividades' end"


@query("p04_sector", WITH + f"select pessoa, {_SECTOR} setor from persons")
def p04(spark, d):
    df = persons(spark, d).select("pessoa", F.col("divisao").try_cast("int").alias("div"))
    return R.range_recode(df, "div", R.SECTORS_2010, "setor", "outras_atividades").select("pessoa", "setor")


@query("p05_override", WITH + "select pessoa, case when raca_cod in ('4','5') then 'domestico' when anos_estudo between 5 and 9 then 'extrativa' when idade > 40 then 'comercio' end setor from persons")
def p05(spark, d):
    rules = [(F.col("idade") > 40, "comercio"), (F.col("anos_estudo").between(5, 9), "extrativa"), (F.col("raca_cod").isin("4", "5"), "domestico")]
    return persons(spark, d).select("pessoa", R.override_chain(rules).alias("setor"))


@query("p06_schooling", WITH + """select pessoa, case when anos_estudo in (20,30) then 'nao_determinado' when anos_estudo <= 7 then 'sem_instrucao_fund_incompleto'
 when anos_estudo <= 10 then 'fund_completo_medio_incompleto' when anos_estudo <= 14 then 'medio_completo_sup_incompleto' when anos_estudo <= 17 then 'superior_completo' end nivel from persons""")
def p06(spark, d):
    return persons(spark, d).select("pessoa", R.schooling_band(F.col("anos_estudo")).alias("nivel"))


@query("p07_wage_bands", WITH + """select pessoa, case when renda / 500 = 0 then 'sem_rendimento' when renda / 500 <= 0.5 then 'ate_1_2' when renda / 500 <= 1 then '1_2_a_1' when renda / 500 <= 2 then '1_a_2'
 when renda / 500 <= 3 then '2_a_3' when renda / 500 <= 5 then '3_a_5' when renda / 500 <= 10 then '5_a_10' when renda / 500 > 10 then 'mais_de_10' end faixa from persons""")
def p07(spark, d):
    return persons(spark, d).select("pessoa", R.wage_band(F.col("renda") / 500).alias("faixa"))


@query("p09_age_bands", WITH + """select pessoa, case when idade >= 80 then '80_mais' when idade is not null then lpad((idade // 5 * 5)::varchar, 2, '0') || '_' || lpad((idade // 5 * 5 + 4)::varchar, 2, '0') end faixa from persons""")
def p09(spark, d):
    return persons(spark, d).select("pessoa", R.age_band(F.col("idade")).alias("faixa"))


@query("p10_age_groups", WITH + """select pessoa, case when idade <= 14 then '00_14' when idade <= 24 then '15_24' when idade <= 39 then '25_39' when idade <= 59 then '40_59' when idade >= 60 then '60_mais' end grupo,
 case when tempo_moradia < 1 then 'menos_1' when tempo_moradia <= 4 then '1_a_4' when tempo_moradia <= 9 then '5_a_9' when tempo_moradia <= 19 then '10_a_19' when tempo_moradia >= 20 then '20_mais' end tempo from persons""")
def p10(spark, d):
    tenure = R.band(F.col("tempo_moradia"), [1, 5, 10, 20], ["menos_1", "1_a_4", "5_a_9", "10_a_19", "20_mais"], right=False)
    return persons(spark, d).select("pessoa", R.band(F.col("idade"), *R.AGE_GROUPS).alias("grupo"), tenure.alias("tempo"))


@query("p10_density", WITH + "select controle, case when densidade <= 1 then 'ate_1' when densidade <= 2 then '1_a_2' when densidade <= 3 then '2_a_3' when densidade > 3 then 'mais_de_3' end faixa from dwellings")
def p10b(spark, d):
    return dwellings(spark, d).select("controle", R.band(F.col("densidade"), *R.DENSITY_BANDS).alias("faixa"))


@query("p11_adequacy", WITH + "select controle, case agua::int + esgoto::int + lixo::int when 3 then 'adequada' when 0 then 'inadequada' when 1 then 'semi_adequada' when 2 then 'semi_adequada' end adequacao from dwellings")
def p11(spark, d):
    return dwellings(spark, d).select("controle", R.adequacy(F.col("agua"), F.col("esgoto"), F.col("lixo")).alias("adequacao"))


@query("p13_flag_text", WITH + "select controle, case when agua then 'sim' when not agua then 'nao' end agua_txt from dwellings")
def p13(spark, d):
    return dwellings(spark, d).select("controle", F.when(F.col("agua"), "sim").when(~F.col("agua"), "nao").alias("agua_txt"))


@query("p15_valid_code", WITH + "select pessoa, coalesce(mun_origem <> '' and mun_origem <> '9999999', false) valida, coalesce(right(mun_origem, 5) = '00000', false) so_uf from persons")
def p15(spark, d):
    return persons(spark, d).select("pessoa", M.valid_origin(F.col("mun_origem")).alias("valida"), F.coalesce(F.right("mun_origem", F.lit(5)) == "00000", F.lit(False)).alias("so_uf"))


@query("p21_sentinel", WITH + "select pessoa, case when idade not in (31, 94) then idade end idade from persons")
def p21(spark, d):
    return persons(spark, d).select("pessoa", R.sentinel(F.col("idade"), 31, 94).alias("idade"))


@query("p23_deflate", WITH + ", idx as (select ano as year, 100::double + 7.31::double * (ano - 1995) as level from persons where ano <> 1997 group by ano) select pessoa, round(renda * (select max(level) from idx where year = 2000) / level, 2) real from persons left join idx on ano = year")
def p23(spark, d):
    df = persons(spark, d)
    index = df.where("ano <> 1997").select(F.col("ano").alias("year")).distinct().withColumn("level", 100.0 + 7.31 * (F.col("year") - 1995))
    return R.deflate(df, "renda", "ano", index, 2000, "real").select("pessoa", F.round("real", 2).alias("real"))


@query("p01_more_recodes", WITH + f"select pessoa, {_case('raca_cod', R.POSITION)} posicao, {_case('sexo_cod', R.TENURE)} condicao, {_case('divisao', R.DWELLING)} tipo from persons")
def p01b(spark, d):
    maps = {"posicao": ("raca_cod", R.POSITION), "condicao": ("sexo_cod", R.TENURE), "tipo": ("divisao", R.DWELLING)}
    return persons(spark, d).select("pessoa", *[R.recode(F.col(col), m).alias(n) for n, (col, m) in maps.items()])


_SECTOR_2000 = "case " + " ".join(f"when divisao::int between {a} and {b} then '{s}'" for a, b, s in R.SECTORS_2000) + " else 'outras_atividades' end"


@query("p04_sector_2000", WITH + f"select pessoa, {_SECTOR_2000} setor from persons")
def p04b(spark, d):
    df = persons(spark, d).select("pessoa", F.col("divisao").try_cast("int").alias("div"))
    return R.range_recode(df, "div", R.SECTORS_2000, "setor", "outras_atividades").select("pessoa", "setor")


@query("p05_sector_1991", WITH + """select pessoa, case when sexo_cod::int + 3 in (4, 5) and raca_cod = '6' then 'domestico' when divisao::int between 50 and 59 then 'extrativa_mineral' when anos_estudo = 1 then 'agropecuaria' when anos_estudo = 2 then 'transformacao'
 when anos_estudo = 3 then 'construcao' when anos_estudo in (4, 11) then 'outras_atividades' when anos_estudo = 5 then 'comercio' when anos_estudo in (6, 7, 8) then 'servicos' when anos_estudo in (9, 10) then 'adm_publica_educacao_saude' end setor from persons""")
def p05b(spark, d):
    position = F.when(F.col("raca_cod") == "6", F.col("sexo_cod").cast("int") + 3)
    return persons(spark, d).select("pessoa", R.sector_1991(F.col("anos_estudo"), F.col("divisao").cast("int"), position).alias("setor"))


_NAMES = ["pessoas", "pessoas_5mais", "pessoas_10mais", "pessoas_25mais", "ocupados", "com_rendimento", "migrantes_5anos", "migrantes_internos", "chegados", "domicilios"]


@query("p26_universe", WITH + """, u as (select *, migracao_cod tipo0, case when nunca_mudou <> '2' then ano - tempo_moradia end chegada from persons)
 select 'pessoas' universo, count(*) n from u union all select 'pessoas_5mais', count(*) from u where idade >= 5 union all select 'pessoas_10mais', count(*) from u where idade >= 10 union all select 'pessoas_25mais', count(*) from u where idade >= 25
 union all select 'ocupados', count(*) from u where status = 'O' union all select 'com_rendimento', count(*) from u where idade >= 10 and renda > 0 union all select 'migrantes_5anos', count(*) from u where tipo0 in ('1', '2', '3')
 union all select 'migrantes_internos', count(*) from u where tipo0 in ('1', '2') union all select 'chegados', count(*) from u where chegada is not null union all select 'domicilios', count(*) from dwellings""")
def p26(spark, d):
    c = F.col
    kind = R.recode(c("migracao_cod"), {"1": "intraestadual", "2": "interestadual", "3": "internacional", "0": "nao_migrante", "4": "nao_migrante"})
    found = R.universes(c("idade"), c("status") == "O", c("renda"), kind, F.when(c("nunca_mudou") != "2", c("ano") - c("tempo_moradia")))
    people = persons(spark, d).select(F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in found.items() if k != "domicilios"]))).alias("universo"))
    return people.unionByName(dwellings(spark, d).select(F.lit("domicilios").alias("universo"))).groupBy("universo").agg(F.count("*").alias("n"))


@query("p27_slices", WITH + ", s(geo, uf, sit) as (values ('sede', '05', 'urbana'), ('municipio', '05', null), ('estado', null, null)) select geo, count(*) n, sum(peso) pop from persons join s on (uf is null or uf = uf_atual) and (sit is null or sit = situacao) group by geo")
def p27(spark, d):
    slices = spark.createDataFrame([("sede", "05", "urbana"), ("municipio", "05", None), ("estado", None, None)], "geo string, uf string, sit string")
    inside = (F.col("uf").isNull() | (F.col("uf") == F.col("uf_atual"))) & (F.col("sit").isNull() | (F.col("sit") == F.col("situacao")))
    return persons(spark, d).join(F.broadcast(slices), inside).groupBy("geo").agg(F.count("*").alias("n"), F.sum("peso").alias("pop"))


@query("p28_household_flag", WITH + "select controle, controle in (select controle from persons where tempo_moradia < 2) recente from dwellings")
def p28(spark, d):
    recent = persons(spark, d).where("tempo_moradia < 2").select(F.col("controle").alias("_c")).distinct()
    return dwellings(spark, d).join(recent, F.col("controle") == F.col("_c"), "left").select("controle", F.col("_c").isNotNull().alias("recente"))


@query("p34_percent", WITH + "select segmento, case when count(renda) filter (idade > 90) > 0 then round(100.0 * count(*) filter (idade > 92) / count(renda) filter (idade > 90), 1) end pct from persons group by segmento")
def p34(spark, d):
    part, base = F.count_if(F.col("idade") > 92), F.count(F.when(F.col("idade") > 90, F.col("renda")))
    return persons(spark, d).groupBy("segmento").agg(part.alias("a"), base.alias("b")).select("segmento", R.percent(F.col("a"), F.col("b")).alias("pct"))


_STAY = "when nunca_mudou = '2' or tempo_moradia >= 5 then 'nao_migrante'"
_UF = _case("uf_origem", {f"{i:02d}": s for i, s in enumerate(sorted(REGIONS), 1)})
_TYPES = {
    "m01_fixed_date_2022": f"case when migracao_cod = '1' then 'nao_migrante' when migracao_cod = '3' then 'internacional' when migracao_cod = '2' and uf_origem = uf_atual then 'intraestadual' when migracao_cod = '2' and uf_origem <> uf_atual then 'interestadual' {_STAY} end",
    "m02_fixed_date_2010": f"case when migracao_cod = '2' then 'internacional' when migracao_cod = '1' and mun_origem = mun_atual then 'nao_migrante' when migracao_cod = '1' and uf_origem = uf_atual then 'intraestadual' when migracao_cod = '1' and uf_origem <> uf_atual then 'interestadual' {_STAY} end",
    "m03_fixed_date_2000": f"case when migracao_cod in ('1','2') then 'nao_migrante' when migracao_cod = '5' then 'internacional' when migracao_cod in ('3','4') and {_UF} = uf_atual then 'intraestadual' when migracao_cod in ('3','4') and {_UF} <> uf_atual then 'interestadual' {_STAY} end",
}


def typed(spark, d, wave=2022):
    c = F.col
    origin = standard_state(c("uf_origem")) if wave == 2000 else c("uf_origem")  # sequential codes in 2000
    kind = M.fixed_date_type(wave, c("migracao_cod"), origin, c("uf_atual"), c("nunca_mudou") == "2", c("tempo_moradia"), c("mun_origem"), c("mun_atual"))
    return persons(spark, d).withColumn("tipo", kind)


for _wave, (_name, _sql) in zip((2022, 2010, 2000), _TYPES.items()):
    query(_name, WITH + f"select pessoa, {_sql} tipo from persons")(lambda spark, d, w=_wave: typed(spark, d, w).select("pessoa", "tipo"))
TYPED = WITH + f", typed as (select *, {_TYPES['m01_fixed_date_2022']} tipo from persons) "


@query("m05_asked", TYPED + "select pessoa, case when idade >= 5 then tipo end tipo from typed")
def m05(spark, d):
    return typed(spark, d).select("pessoa", M.asked(F.col("tipo"), F.col("idade")).alias("tipo"))


_UF86 = "case cast(uf_origem as int) when 0 then 70 when 1 then 80 when 2 then 99 else cast(uf_origem as int) + 9 end"


@query("m04_fixed_date_1991", WITH + f""", q as (select *, {_UF86} u, right(mun_origem, 4) mo, right(mun_atual, 4) ma from persons)
 select pessoa, case when not idade >= 5 or idade is null then null when u = 80 then 'internacional' when u between 11 and 54 and u <> 15 then 'interestadual' when u = 15 and mo <> '9999' and mo <> ma then 'intraestadual'
 when u = 70 or (u = 15 and mo = ma) or nunca_mudou = '2' or tempo_moradia >= 5 then 'nao_migrante' end tipo from q""")
def m04(spark, d):
    c = F.col
    state, never = F.expr(_UF86), F.when(c("nunca_mudou") == "2", 98)
    kind = M.fixed_date_type_1991(state, F.expr("right(mun_origem, 4)"), F.expr("right(mun_atual, 4)"), F.lit(False), never, c("tempo_moradia"), c("idade"))
    return persons(spark, d).select("pessoa", kind.alias("tipo"))


@query("m06_last_stage", WITH + "select pessoa, case when anos_estudo < 10 then case when migracao_cod = '1' and uf_origem = uf_atual then 'intraestadual' when migracao_cod = '1' and uf_origem <> uf_atual then 'interestadual' when migracao_cod = '2' then 'internacional' end end tipo from persons")
def m06(spark, d):
    c = F.col
    return persons(spark, d).select("pessoa", M.last_stage_type(2010, c("migracao_cod"), c("uf_origem"), c("uf_atual"), c("anos_estudo")).alias("tipo"))


@query("m07_return", WITH + """select pessoa, coalesce(mun_origem <> '' and mun_origem <> '9999999' and mun_origem = mun_atual and migracao_cod = '2', false) r2022,
 coalesce(sexo_cod in ('1', '2') and migracao_cod = '1' and mun_origem <> mun_atual, false) r2010, coalesce((nunca_mudou = '2' or sexo_cod = '1') and migracao_cod in ('3', '4'), false) r2000 from persons""")
def m07(spark, d):
    c = F.col
    always = F.when(c("nunca_mudou") == "2", "1")
    return persons(spark, d).select(
        "pessoa", M.return_2022(c("mun_origem"), c("mun_atual"), c("migracao_cod")).alias("r2022"),
        M.return_2010(c("sexo_cod"), c("migracao_cod"), c("mun_origem"), c("mun_atual")).alias("r2010"), M.return_2000(always, c("sexo_cod"), c("migracao_cod")).alias("r2000"),
    )


_WORK = "case when raca_cod = '0' then '0100008' when raca_cod = '1' then '0200006' when raca_cod = '2' then '9999999' else mun_origem end"


@query("m08_commuting", WITH + f"""select pessoa, coalesce(migracao_cod = '3' and w not in ('', '9999999') and w <> mun_atual, false) p2022, coalesce(w not in ('', '9999999', '0100008', '0200006') and w <> mun_atual, false) p2000 from (select *, {_WORK} w from persons)""")
def m08(spark, d):
    c, work = F.col, F.expr(_WORK)
    return persons(spark, d).select("pessoa", M.commutes(c("migracao_cod") == "3", work, c("mun_atual")).alias("p2022"), M.commutes_2000(work, c("mun_atual")).alias("p2000"))


@query("m09_rate", TYPED + "select uf_atual, count(*) n, count(*) filter (tipo <> 'nao_migrante') n_migrants, sum(peso) population, coalesce(sum(peso) filter (tipo <> 'nao_migrante'), 0) migrants, round(100 * coalesce(sum(peso) filter (tipo <> 'nao_migrante'), 0) / sum(peso), 6) rate from typed where tipo is not null group by uf_atual")
def m09(spark, d):
    return M.in_migration_rate(typed(spark, d), "uf_atual", "tipo", "peso")


_OD = TYPED + ", od as (select mun_origem origin, mun_atual dest, count(*) n, sum(peso) flow from typed where tipo in ('intraestadual','interestadual') and mun_origem <> '' and mun_origem <> '9999999' group by all) "


@query("m10_od_matrix", _OD + "select * from od")
def m10(spark, d):
    return M.od_matrix(typed(spark, d), "mun_origem", "mun_atual", "tipo", "peso")


@query("m11_top_corridors", _OD + "select * from od order by flow desc, origin, dest limit 20")
def m11(spark, d):
    return M.top_k(m10(spark, d), "flow", 20, "origin", "dest")
