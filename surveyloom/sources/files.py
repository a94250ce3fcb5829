"""Text files of statistical offices: fixed-width records, ';' tables of text, decimal commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fixed_width(spark: SparkSession, path: str, layout: dict[str, tuple[int, int]], fields: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """The fields asked for, in that order, as text with its blanks; layout: name -> (start from 0, end). Unknown fields are an error."""
    if unknown := [f for f in fields if f not in layout]:
        raise KeyError(f"not in the layout: {unknown}")
    lines = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(path)
    return lines.select(*[F.substring("line", layout[f][0] + 1, layout[f][1] - layout[f][0]).alias(f) for f in fields])


def write_fixed_width(df: DataFrame, path: str, layout: dict[str, tuple[int, int]], encoding: str = "ISO-8859-1") -> None:
    """Values padded on the right to their widths, without gaps between fields; longer ones are an error, nulls are blank."""
    def field(name: str):
        width = layout[name][1] - layout[name][0]
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(F.char_length(text) <= width, F.rpad(text, width, " ")).otherwise(F.raise_error(F.lit(f"{name} is too long")))

    ordered = sorted(layout, key=lambda k: layout[k])
    line = F.concat(*map(field, ordered)).alias("line")
    options = {"sep": "\u0001", "quote": "", "encoding": encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(line).write.options(**options).csv(path)


def read_text_table(spark: SparkSession, path: str, columns: list[str], types: dict[str, str], encoding: str = "UTF-8") -> DataFrame:
    """A ';' table with a header, every column as text, only `columns` kept; `types` are cast, blanks and misfits to null."""
    df = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path)
    return df.select(*[F.nullif(F.trim(c), F.lit("")).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in columns])


def write_locale_table(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """A ';' table with decimal commas, text in quotes."""
    out = [F.regexp_replace(F.col(c).cast("decimal(38,6)").cast("string"), r"\.", ",").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*out).write.option("sep", ";").option("header", True).option("quoteAll", True).option("encoding", encoding).csv(path)


def read_decimal_comma(spark: SparkSession, path: str, columns: list[str], numbers: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """`read_text_table` with decimal commas in `numbers`."""
    df = read_text_table(spark, path, columns, {}, encoding)
    return df.withColumns({c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double") for c in numbers})
