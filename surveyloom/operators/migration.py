"""Fixed-date migration types, return moves, commuting, rates and origin-destination tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSPECIFIED = "9999999"
MIGRANT = ("intraestadual", "interestadual", "internacional")


def valid_origin(code: Column) -> Column:
    return F.coalesce((code != "") & (code != UNSPECIFIED), F.lit(False))


def _moved(moved: Column, origin_state: Column, state: Column) -> Column:
    return F.when(moved & (origin_state == state), "intraestadual").when(moved & (origin_state != state), "interestadual")


def fixed_date_type(wave: int, answer: Column, origin_state: Column, state: Column, never_moved: Column, tenure: Column,
                    origin: Column | None = None, here: Column | None = None) -> Column:
    """Type by residence five years ago. A direct answer comes first; blanks that the form implies become non-migrant.

    In 2010 a domestic answer that names the present municipality is a return within the window: non-migrant. In 2000
    state codes must be translated first.
    """
    stayed = F.coalesce(never_moved, F.lit(False)) | F.coalesce(tenure >= 5, F.lit(False))
    if wave == 2022:
        direct = [F.when(answer == "1", "nao_migrante").when(answer == "3", "internacional"), _moved(answer == "2", origin_state, state)]
    elif wave == 2010:
        same = F.coalesce(origin == here, F.lit(False))
        direct = [F.when(answer == "2", "internacional").when((answer == "1") & same, "nao_migrante"), _moved(answer == "1", origin_state, state)]
    elif wave == 2000:
        direct = [F.when(answer.isin("1", "2"), "nao_migrante").when(answer == "5", "internacional"), _moved(answer.isin("3", "4"), origin_state, state)]
    else:
        raise ValueError(f"no fixed-date question in {wave}")
    return F.coalesce(*direct, F.when(stayed, "nao_migrante"))


# Fixed values of the 1991 form: own state, "same municipality", "abroad", unknown municipality, "never moved".
OWN_STATE_1991, HERE_1991, ABROAD_1991, UNKNOWN_1991, NEVER_1991 = 15, 70, 80, "9999", 98


def fixed_date_type_1991(state: Column, municipality: Column, here: Column, born_here: Column, last_move: Column, tenure: Column, age: Column) -> Column:
    """Type by residence five years ago in 1991: codes of states and special codes in one field, municipalities of the own state."""
    own, known = state == OWN_STATE_1991, F.coalesce(municipality != UNKNOWN_1991, F.lit(True))
    stayed = F.coalesce(born_here, F.lit(False)) | F.coalesce(last_move == NEVER_1991, F.lit(False)) | F.coalesce(tenure >= 5, F.lit(False))
    answered = F.when(state == ABROAD_1991, "internacional").when(state.between(11, 54) & ~own, "interestadual").when(own & known & (municipality != here), "intraestadual")
    kind = answered.when((state == HERE_1991) | (own & (municipality == here)) | stayed, "nao_migrante")
    return asked(kind, age)


def last_stage_type(wave: int, answer: Column, origin_state: Column, state: Column, tenure: Column) -> Column:
    """Type of the last move, asked only of those who came less than ten years ago; not asked in 2000."""
    if wave == 2000:
        raise NotImplementedError("the 2000 wave has no municipality of previous residence")
    direct = F.coalesce(_moved(answer == "1", origin_state, state), F.when(answer == "2", "internacional"))
    return F.when(tenure < 10, direct)


def is_return(born_here: Column, moved_in_window: Column) -> Column:
    return F.coalesce(born_here & moved_in_window, F.lit(False))


def return_2022(birthplace: Column, here: Column, answer: Column) -> Column:
    return is_return(valid_origin(birthplace) & (birthplace == here), answer == "2")


def return_2010(born_here: Column, answer: Column, origin: Column, here: Column) -> Column:
    """Born here (always or with a time away); the answer alone doesn't say that the last place was another one."""
    return is_return(born_here.isin("1", "2"), (answer == "1") & (origin != here))


def return_2000(always_here: Column, born_here: Column, answer: Column) -> Column:
    return is_return(F.coalesce(always_here == "1", F.lit(False)) | F.coalesce(born_here == "1", F.lit(False)), answer.isin("3", "4"))


# Fixed values of the 2000 form: works or studies here; neither works nor studies.
HERE_2000, NEITHER_2000 = "0100008", "0200006"


def commutes(elsewhere: Column, work: Column, home: Column) -> Column:
    """2010 and 2022: the answer says another municipality, and a known one that isn't the home."""
    return F.coalesce(elsewhere & valid_origin(work) & (work != home), F.lit(False))


def commutes_2000(work: Column, home: Column) -> Column:
    """2000: one code for work or study, two of whose values are no places."""
    place = F.trim(work)
    return commutes(valid_origin(place) & ~place.isin(HERE_2000, NEITHER_2000), place, home)


def asked(kind: Column, age: Column, least: int = 5) -> Column:
    return F.when(age >= least, kind)


def in_migration_rate(df: DataFrame, unit: str, kind: str, weight: str) -> DataFrame:
    """Sample and weighted counts with the rate in percent; unknown types are no part of the base."""
    came = F.col(kind).isin(*MIGRANT)
    return df.where(F.col(kind).isNotNull()).groupBy(unit).agg(
        F.count("*").alias("n"), F.count_if(came).alias("n_migrants"), F.sum(weight).alias("population"),
        F.sum(F.when(came, F.col(weight)).otherwise(0.0)).alias("migrants"),
    ).withColumn("rate", F.round(100 * F.col("migrants") / F.col("population"), 6))


def od_matrix(df: DataFrame, origin: str, dest: str, kind: str, weight: str) -> DataFrame:
    moved = F.col(kind).isin("intraestadual", "interestadual")
    return df.where(moved & valid_origin(F.col(origin))).groupBy(F.col(origin).alias("origin"), F.col(dest).alias("dest")).agg(F.count("*").alias("n"), F.sum(weight).alias("flow"))


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)
