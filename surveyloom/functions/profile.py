"""Profile variables of persons and dwellings: concepts by wave, skip patterns, birthplace, arrival, labels, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recode import band, recode

# Fixed values of the harmonised schema: state code -> region, last years of arrival periods, 1991 income codes, formal jobs.
REGIONS = {
    "11": "Norte", "12": "Norte", "13": "Norte", "14": "Norte", "15": "Norte", "16": "Norte", "17": "Norte",
    "21": "Nordeste", "22": "Nordeste", "23": "Nordeste", "24": "Nordeste", "25": "Nordeste", "26": "Nordeste", "27": "Nordeste", "28": "Nordeste", "29": "Nordeste",
    "31": "Sudeste", "32": "Sudeste", "33": "Sudeste", "35": "Sudeste", "41": "Sul", "42": "Sul", "43": "Sul",
    "50": "Centro-Oeste", "51": "Centro-Oeste", "52": "Centro-Oeste", "53": "Centro-Oeste",
}
ARRIVAL = ([1984, 1994, 2001, 2004, 2012, 2016], ["ate_1984", "1985_1994", "1995_2001", "2002_2004", "2005_2012", "2013_2016", "2017_2022"])
INCOME_1991 = {
    "1": "ate_1_2", "2": "ate_1_2", "3": "1_2_a_1", "4": "1_2_a_1", "5": "1_a_2", "6": "1_a_2", "7": "1_a_2", "8": "2_a_3",
    "9": "3_a_5", "10": "5_a_10", "11": "mais_de_10", "12": "mais_de_10", "13": "mais_de_10", "14": "sem_rendimento",
}
FORMAL = ["empregado_com_carteira", "militar_estatutario"]


def concept(registry: dict[str, dict[int, str | None]], name: str, wave: int) -> Column:
    """The column that holds a concept in a wave; an error, never a null column, where it wasn't asked."""
    source = registry.get(name, {}).get(wave)
    if source is None:
        raise LookupError(f"{name} is not available in {wave}")
    return F.expr(source).alias(name)


def by_wave(registry: dict[str, dict[int, str | None]], name: str, wave: str, waves: list[int]) -> Column:
    """A concept over a table of several waves, each row by its own wave's column."""
    return reduce(lambda out, w: F.when(F.col(wave) == w, concept(registry, name, w)).otherwise(out), waves, F.lit(None)).alias(name)


def standard_state(sequential: Column) -> Column:
    """Sequential state numbers '01'... as standard codes: the n-th known code in order; others null."""
    return recode(sequential, {f"{i:02d}": code for i, code in enumerate(sorted(REGIONS), 1)})


def arrival_period(year: Column) -> Column:
    return F.when(year <= 2022, band(year, *ARRIVAL))


def origin_region(kind: Column, origin_state: Column) -> Column:
    """'mesma_uf' within the state, the region of another state, 'exterior'; null for all others."""
    return F.when(kind == "intraestadual", "mesma_uf").when(kind == "interestadual", recode(origin_state, REGIONS)).when(kind == "internacional", "exterior")


def birthplace(answer: Column, birth_state: Column, state: Column) -> Column:
    """Answers 1 here, 2 elsewhere in the country, 3 abroad; elsewhere needs a known state."""
    known = birth_state != ""
    return F.when(answer == "1", "municipio").when(answer == "3", "exterior").when((answer == "2") & (birth_state == state), "mesma_uf").when((answer == "2") & known, "outra_uf")


def birthplace_2010(born_here: Column, same_state: Column, code: Column, birth_state: Column, state: Column) -> Column:
    """1 or 2 is this municipality; elsewhere the state is that of the answer or of the code; a code of no state is abroad."""
    away = born_here == "3"
    return (
        F.when(born_here.isin("1", "2"), "municipio").when(away & birth_state.isNull() & (F.trim(code) != ""), "exterior")
        .when(away & (birth_state != state), "outra_uf").when(away & (same_state.isin("1", "2") | (birth_state == state)), "mesma_uf")
    )


def birthplace_2000(always_here: Column, born_here: Column, code: Column, birth_state: Column, state: str) -> Column:
    """A blank code means this state; a code of another state, or of none, decides for those born elsewhere."""
    away = born_here == "2"
    return (
        F.when((always_here == "1") | (born_here == "1"), F.when(away & (F.trim(code) != "") & birth_state.isNull(), "exterior").when(away & (birth_state != state), "outra_uf").otherwise("municipio"))
        .when(away & (F.trim(code) == ""), "mesma_uf").when(away & (birth_state != state), "outra_uf").when(away & birth_state.isNull(), "exterior")
    )


def birthplace_1991(answer: Column, code: Column, birth_state: Column, state: str) -> Column:
    """Answers 1 and 2 are this municipality; codes from 30 on are countries."""
    away = answer == 3
    return F.when(answer.isin(1, 2), "municipio").when(away & (code >= 30), "exterior").when(away & (birth_state == state), "mesma_uf").when(away & birth_state.isNotNull(), "outra_uf")


def arrival_year(wave: int, years: Column, moved: Column) -> Column:
    """The wave's year less the years here, for those who came from elsewhere."""
    return F.when(moved, F.lit(wave) - years)


def tenure(years: Column, age: Column, asked: Column, never_moved: Column) -> Column:
    """Years lived here: the age of those who never moved, the answer of those asked."""
    return F.when(never_moved, age).when(asked, years)


def among(value: Column, members: list[str]) -> Column:
    """Membership that stays null where the value is null."""
    return F.when(value.isNotNull(), value.isin(*members))


def implied_false(value: Column, gate_closed: Column, not_asked: Column) -> Column:
    """A skipped question is 'no' where the gate answer implies it, null where it wasn't asked at all."""
    return F.when(F.coalesce(not_asked, F.lit(False)), None).when(F.coalesce(gate_closed, F.lit(False)), False).otherwise(value)


def implied_decimal(number: Column, decimals: int) -> Column:
    return number.cast("double") / 10.0**decimals


def fused_label(category: Column, labels: dict[str, str]) -> Column:
    """Labels of categories; 'outros:a+b' becomes 'Outros (A, B)'; unknown categories stay as they are, null is empty."""
    one = lambda c: F.coalesce(recode(c, labels), c)
    parts = F.transform(F.split(F.substring(category, 8, 1 << 20), r"\+"), one)
    return F.coalesce(F.when(category.startswith("outros:"), F.concat(F.lit("Outros ("), F.array_join(parts, ", "), F.lit(")"))).otherwise(one(category)), F.lit(""))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def any_prefix(columns: list[Column], prefix: str) -> Column:
    return F.coalesce(F.exists(F.array(*columns), lambda c: c.startswith(prefix)), F.lit(False))


def geometric_rate(first: Column, last: Column, years: Column) -> Column:
    """Mean yearly growth in percent; null where a level is not positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(last / first, 1 / years) - 1) * 100)


def text_from_index(positions: Column) -> Column:
    """Text of an inverted index map<word, array<int>>: words in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def has_all_terms(normalised: Column, terms: list[str]) -> Column:
    return F.coalesce(F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(normalised, t)), F.lit(False))
