"""Recodes, bands and small text functions as column expressions (nulls in, nulls out unless said otherwise)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the harmonised schema: categories by code, income bands in minimum wages, sectors by division.
SEX = {"1": "M", "2": "F"}
RACE = {"1": "branca", "2": "preta", "3": "amarela", "4": "parda", "5": "indigena", "9": "ignorado"}
SECTORS_2010 = [
    (1, 3, "agropecuaria"), (5, 9, "extrativa_mineral"), (10, 33, "transformacao"), (35, 39, "outras_atividades"),
    (41, 43, "construcao"), (45, 48, "comercio"), (49, 82, "servicos"), (84, 88, "adm_publica_educacao_saude"),
    (90, 96, "servicos"), (97, 97, "domestico"), (99, 99, "outras_atividades"),
]
SECTORS_2000 = [
    (1, 5, "agropecuaria"), (10, 14, "extrativa_mineral"), (15, 37, "transformacao"), (40, 41, "outras_atividades"),
    (45, 45, "construcao"), (50, 53, "comercio"), (55, 74, "servicos"), (75, 75, "adm_publica_educacao_saude"),
    (80, 85, "adm_publica_educacao_saude"), (90, 93, "servicos"), (95, 95, "domestico"), (99, 99, "outras_atividades"),
]
POSITION = {"1": "empregado_com_carteira", "2": "militar_estatutario", "3": "empregado_sem_carteira", "4": "conta_propria", "5": "empregador", "6": "nao_remunerado", "7": "nao_remunerado"}
TENURE = {"1": "proprio", "2": "proprio", "3": "alugado", "4": "cedido_empregador", "5": "cedido_outro", "6": "outra"}
DWELLING = {"11": "casa", "12": "casa", "13": "apartamento", "14": "comodo", "15": "outro"}
WAGE_BANDS = ([0.5, 1, 2, 3, 5, 10], ["ate_1_2", "1_2_a_1", "1_a_2", "2_a_3", "3_a_5", "5_a_10", "mais_de_10"])
AGE_GROUPS = ([14, 24, 39, 59], ["00_14", "15_24", "25_39", "40_59", "60_mais"])
DENSITY_BANDS = ([1, 2, 3], ["ate_1", "1_a_2", "2_a_3", "mais_de_3"])
SCHOOLING = ([7, 10, 14, 17], ["sem_instrucao_fund_incompleto", "fund_completo_medio_incompleto", "medio_completo_sup_incompleto", "superior_completo", None])


def recode(code: Column, mapping: dict[str, str]) -> Column:
    """The category of a code; unmapped codes become null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), code)


def sector_1991(branch: Column, activity: Column, position: Column) -> Column:
    """Sector from the 1991 branch; mining activities override it, domestic positions override both."""
    # Fixed values of the 1991 form.
    branches = {"agropecuaria": [1], "transformacao": [2], "construcao": [3], "outras_atividades": [4, 11], "comercio": [5], "servicos": [6, 7, 8], "adm_publica_educacao_saude": [9, 10]}
    rules = [(branch.isin(codes), name) for name, codes in branches.items()]
    return override_chain([*rules, (activity.between(50, 59), "extrativa_mineral"), (position.isin(4, 5), "domestico")])


def universes(age: Column, working: Column, income: Column, kind: Column, arrival: Column) -> dict[str, Column]:
    """The ten named universes as predicates (unknown counts as outside); dwellings are a level of their own."""
    found = {
        "pessoas": F.lit(True), "pessoas_5mais": age >= 5, "pessoas_10mais": age >= 10, "pessoas_25mais": age >= 25, "ocupados": working, "com_rendimento": (age >= 10) & (income > 0),
        "migrantes_5anos": kind.isin("intraestadual", "interestadual", "internacional"), "migrantes_internos": kind.isin("intraestadual", "interestadual"),
        "chegados": arrival.isNotNull(), "domicilios": F.lit(True),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def tristate(code: Column, true: list, valid: list) -> Column:
    """True for codes in `true`, false for other valid codes, else null."""
    return F.when(code.isin(true), True).when(code.isin(valid), False)


def override_chain(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Later rules win; a null condition doesn't apply."""
    return reduce(lambda out, rule: F.when(rule[0], F.lit(rule[1])).otherwise(out), rules, F.lit(None) if default is None else default)


def band(value: Column, cuts: list, labels: list, right: bool = True) -> Column:
    """The label of the interval that holds the value; intervals are closed on the right by default."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(value <= cut if right else value < cut, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def wage_band(multiple: Column) -> Column:
    return F.when(multiple == 0, "sem_rendimento").when(multiple > 0, band(multiple, *WAGE_BANDS))


def schooling_band(years: Column) -> Column:
    return F.when(years.isin(20, 30), "nao_determinado").otherwise(band(years, *SCHOOLING))


def age_band(age: Column, width: int = 5, top: int = 80) -> Column:
    """'05_09'-like bands with an open top."""
    low = F.floor(age / width) * width
    label = F.concat(F.lpad(low.cast("string"), 2, "0"), F.lit("_"), F.lpad((low + width - 1).cast("string"), 2, "0"))
    return F.when(low >= top, F.lit(f"{top}_mais")).when(low.isNotNull(), label)


def adequacy(*services: Column) -> Column:
    """Three classes by how many services there are; null if one is unknown."""
    n = reduce(lambda a, b: a + b, [s.cast("int") for s in services])
    return F.when(n == len(services), "adequada").when(n >= 1, "semi_adequada").when(n == 0, "inadequada")


def range_recode(df: DataFrame, value: str, ranges: list[tuple[int, int, str]], out: str, default: str) -> DataFrame:
    """A broadcast range join with a table of (low, high, label) of fixed size; values in no range get the default, null stays."""
    table = df.sparkSession.createDataFrame(ranges, "_low int, _high int, _label string")
    joined = df.join(F.broadcast(table), F.col(value).between(F.col("_low"), F.col("_high")), "left")
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce("_label", F.lit(default)))).drop("_low", "_high", "_label")


def locale_number(text: Column) -> Column:
    """'1.234,56' to a double; anything else to null."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".").try_cast("double")


def blank_to_number(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def sentinel(value: Column, *codes) -> Column:
    return F.when(~value.isin(*codes), value)


def percent(part: Column, base: Column, digits: int = 1) -> Column:
    """Part of a base in percent; null where the base is zero or less."""
    return F.when(base > 0, F.round(100 * part / base, digits))


def deflate(df: DataFrame, value: str, year: str, index: DataFrame, base: int, out: str) -> DataFrame:
    """Value in money of the base year, by an index table (year, level); null where the year has no level."""
    levels = index.select(F.col("year").alias("_y"), F.col("level").alias("_l"))
    at = levels.where(F.col("_y") == base).agg(F.max("_l").alias("_b"))
    return df.join(levels, F.col(year) == F.col("_y"), "left").crossJoin(F.broadcast(at)).withColumn(out, F.col(value) * F.col("_b") / F.col("_l")).drop("_y", "_l", "_b")


ACCENTS = ("áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")


def normalise(text: Column) -> Column:
    """Without accents, in lower case, only a-z, 0-9 and single spaces."""
    plain = F.lower(F.translate(text, *ACCENTS))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), " +", " "))


def title_key(text: Column, length: int = 120) -> Column:
    return F.substring(normalise(text), 1, length)


def html_text(html: Column) -> Column:
    """Visible text: script and style dropped, tags to spaces, the five basic entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def redact(df: DataFrame, pattern: str = EMAIL, token: str = "[email]") -> DataFrame:
    """Replace a pattern in every text column."""
    return df.withColumns({c: F.regexp_replace(c, pattern, token) for c, kind in df.dtypes if kind == "string"})


def round_to(value: Column, base: int = 10) -> Column:
    """Half-even rounding to a multiple of `base`."""
    return F.bround(value / base) * base


def precision_class(cv: Column) -> Column:
    return F.when(cv.isNull(), "sem_estimativa").when(cv <= 15, "boa").when(cv <= 30, "cautela").otherwise("baixa")


def sample_band(n: Column) -> Column:
    return F.when(n < 5, "<5").otherwise(band(n, [9, 19, 49, 99, 499], ["5-9", "10-19", "20-49", "50-99", "100-499", ">=500"]))
