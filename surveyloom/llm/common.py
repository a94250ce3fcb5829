"""Shared pieces of the operators: tables, stored steps, rows told apart by id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, stored as materialise

__all__ = ["crc32_of_id", "fresh", "least_by_hash", "materialise", "parallelism", "shared_dir", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of `taken` is, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with all its columns, but for rows whose id and hash of text are in `gone` (doc_id, print)."""
    i, p = fresh("gone_id", docs.columns), fresh("gone_print", docs.columns)
    gone = gone.select(F.col("doc_id").alias(i), F.col("print").alias(p))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(p))
    return docs.join(gone, same, "left_anti")


def least_by_hash(rows: DataFrame, hashed: list[str], n_rows: int, sample: int) -> DataFrame:
    """The `sample` rows of least hash. A bound taken from the count cuts all but about 1.25 * sample before the sort."""
    h = F.xxhash64(*hashed)
    if n_rows > 2 * sample + 1000:
        share = (1.25 * sample + 200) / n_rows
        rows = rows.where(h < int(-(2**63) + share * 2**64))
    return rows.orderBy(h, *hashed).limit(sample)
