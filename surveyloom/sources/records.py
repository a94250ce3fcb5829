"""JSON answers to tables, prefix-filtered reads, exports, schema contracts and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks of values that a statistical office withholds.
WITHHELD = ["X", "...", "-", "..", "NA", ""]


def prefixed(df: DataFrame, code: str, prefix: str) -> DataFrame:
    """Rows whose code begins with the prefix; on Parquet the filter reaches the scan."""
    return df.where(F.col(code).startswith(prefix))


def api_table(answers: DataFrame, text: str, axes: dict[str, str], keep: list[str]) -> DataFrame:
    """A statistical service's answer (an array of objects, the first of which names the fields) as rows.

    axes: short key of an axis ('D1') to a column name; code and name come out as <name>_codigo and <name>, with the answer's own
    heading as <name>_rotulo. Withheld values are null; decimals may use a comma.
    """
    rows = F.from_json(text, "array<map<string,string>>")
    one = answers.select(*keep, rows.alias("_r")).select(*keep, F.get("_r", F.lit(0)).alias("_h"), F.explode(F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0)))).alias("_v"))
    raw = F.col("_v")["V"]
    value = F.when(~raw.isin(WITHHELD), F.replace(raw, F.lit(","), F.lit(".")).try_cast("double"))
    named = [x for k, n in axes.items() for x in (F.col("_v")[f"{k}C"].alias(f"{n}_codigo"), F.col("_v")[f"{k}N"].alias(n), F.col("_h")[f"{k}N"].alias(f"{n}_rotulo"))]
    return one.select(*keep, value.alias("valor"), F.col("_v")["MN"].alias("unidade"), *named)


def nested_indicators(answers: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, ano, valor from blocks of results: [{res: [{res: {year: value}}]}]."""
    blocks = F.from_json(text, "array<struct<res: array<struct<res: map<string,string>>>>>")
    results = answers.select(*keep, F.explode(blocks).alias("b")).select(*keep, F.explode("b.res").alias("r"))
    return results.select(*keep, F.explode("r.res").alias("ano", "valor"))


def write_both(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The same table as Parquet and as CSV under `path`, read back."""
    df.write.mode("errorifexists").parquet(f"{path}/parquet")
    df.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    spark = df.sparkSession
    return spark.read.parquet(f"{path}/parquet"), spark.read.schema(df.schema).option("header", True).csv(f"{path}/csv")


def json_lines(df: DataFrame, digits: int = 4) -> DataFrame:
    """One JSON object a row (column `value`): numbers that aren't finite are null, whole ones have no decimals, others `digits`."""
    def clean(c: str) -> Column:
        finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(finite, F.round(c, digits)).alias(c)

    cleaned = [clean(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    text = F.to_json(F.struct(*cleaned), {"ignoreNullFields": "false"})
    return df.select(F.regexp_replace(text, r'(?<=[^\\]":)(-?\d+)\.0(?=[,}])', "$1").alias("value"))


def write_json(df: DataFrame, path: str) -> DataFrame:
    json_lines(df).write.mode("errorifexists").text(path)
    return df.sparkSession.read.text(path)


def contract(fields: DataFrame, dictionary: DataFrame, needed: dict[str, str]) -> DataFrame:
    """(field, problem) of needed fields that a table lacks (names in any case) or whose dictionary text lacks the expected
    fragment. fields: field; dictionary: field, text; needed: field to fragment."""
    spark = fields.sparkSession
    want = spark.createDataFrame(list(needed.items()), "field string, fragment string").withColumn("_k", F.lower("field"))
    have = fields.select(F.lower("field").alias("_k")).distinct().withColumn("_have", F.lit(True))
    said = dictionary.select(F.lower("field").alias("_k"), "text").groupBy("_k").agg(F.max("text").alias("text"))
    out = want.join(have, "_k", "left").join(said, "_k", "left")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("text").isNull(), "not in the dictionary").when(~F.contains("text", "fragment"), "unexpected text")
    return out.select("field", problem.alias("problem")).where("problem is not null")


def column_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(c,) for c in df.columns], "field string")


def export_reconciliation(source: dict[str, DataFrame], exported: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(table, source_rows, exported_rows, missing_keys, extra_keys) of every table on either side."""
    def one(name: str) -> DataFrame:
        a, b, k = source.get(name), exported.get(name), keys[name]
        sides = [df.select(F.col(k).cast("string").alias("k")) if df is not None else None for df in (a, b)]
        none = (a if a is not None else b).sparkSession.createDataFrame([], "k string")
        left, right = (s if s is not None else none for s in sides)
        both = left.groupBy("k").agg(F.count("*").alias("x")).join(right.groupBy("k").agg(F.count("*").alias("y")), "k", "full")
        return both.agg(
            F.lit(name).alias("table"), F.coalesce(F.sum("x"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("exported_rows"),
            F.count_if(F.col("y").isNull()).alias("missing_keys"), F.count_if(F.col("x").isNull()).alias("extra_keys"),
        )

    return reduce(DataFrame.unionByName, [one(n) for n in sorted({*source, *exported})])


RECORD = ["fonte", "id_fonte", "titulo", "autores", "ano", "doi"]


def first_year(*dates: Column) -> Column:
    """The year of the first date that has one: {date-parts: [[year, ...]]} objects, texts that begin with a year, or numbers."""
    return F.coalesce(*dates).cast("int")


def date_parts(column: str) -> Column:
    return F.get(F.get(F.col(column), F.lit(0)), F.lit(0))


def unify(sources: list[tuple[str, DataFrame, str, str, dict[str, Column]]]) -> DataFrame:
    """Records of differently shaped JSON sources in one schema. sources: name, table, JSON column, its schema, and the
    expressions of id_fonte, titulo, autores (array), ano and doi over the parsed column `j`."""
    def one(name, df, text, schema, fields):
        parsed = df.select(F.from_json(text, schema).alias("j"))
        doi = F.nullif(F.regexp_replace(F.lower(fields.get("doi", F.lit(None).cast("string"))), "^https?://(dx\\.)?doi\\.org/", ""), F.lit(""))
        return parsed.select(
            F.lit(name).alias("fonte"), fields["id_fonte"].cast("string").alias("id_fonte"), F.coalesce(fields["titulo"], F.lit("")).alias("titulo"),
            F.array_join(fields["autores"], "; ").alias("autores"), fields["ano"].cast("int").alias("ano"), doi.alias("doi"),
        )

    return reduce(DataFrame.unionByName, [one(*s) for s in sources])
