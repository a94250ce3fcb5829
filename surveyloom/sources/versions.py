"""Stored tables that are replaced by partition: data files never change, and a manifest names those of the newest version.

A table is a folder. `data/` holds a folder of Parquet files a write, dealt by a partition column; `manifest/v=N` is one small file
that lists the files of version N. It's written last and appears by one rename, so a lost job leaves the version before readable
and unchanged, and a second writer of the same version fails. Files that no version needs any more stay until the folder goes.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .storage import new_path

VERSION = "_version"


def unused(spark: SparkSession) -> str:
    """A folder for a new table, in the shared folder."""
    return new_path(spark)


def _manifest(spark: SparkSession, table: str) -> tuple[int, str, StructType, DataFrame]:
    """Newest version, its partition column, its schema and its files (part, file)."""
    every = spark.read.schema("part string, file string, fields string, v int").parquet(f"{table}/manifest")
    head = every.where("fields is not null").orderBy(F.desc("v")).first()
    return head["v"], head["part"], StructType.fromJson(json.loads(head["fields"])), every.where((F.col("v") == head["v"]) & F.col("file").isNotNull()).select("part", "file")


def _write(df: DataFrame, table: str, part: str, version: int) -> DataFrame:
    """Write rows as new files and return them: (part, file)."""
    spark, folder = df.sparkSession, f"{table}/data/{uuid.uuid4().hex}"
    named = F.md5(F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("")))  # a folder name of any value, null too
    df.withColumns({VERSION: F.lit(version), "_p": named}).write.partitionBy("_p").parquet(folder)
    back = spark.read.schema(StructType(df.schema.fields)).parquet(folder)
    return back.select(F.col(part).cast("string").alias("part"), F.col("_metadata.file_path").alias("file")).distinct()


def _publish(files: DataFrame, table: str, part: str, schema: StructType, version: int) -> None:
    head = files.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(None).cast("string").alias("file"), F.lit(schema.json()).alias("fields"))
    files.withColumn("fields", F.lit(None).cast("string")).unionByName(head).coalesce(1).write.parquet(f"{table}/manifest/v={version}")  # a row a file


def create(df: DataFrame, table: str, part: str) -> str:
    """Write version 1. part: the column whose values are replaced as a whole. Rows with a null there are a partition too."""
    _publish(_write(df, table, part, 1), table, part, df.schema, 1)
    return table


def files(spark: SparkSession, table: str) -> DataFrame:
    """(part, file) of the newest version; part is the partition's value as text."""
    return _manifest(spark, table)[3]


def _rows(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    full = StructType(schema.fields).add(VERSION, IntegerType())
    return spark.read.schema(full).parquet(*paths) if paths else spark.createDataFrame([], full)


def read(spark: SparkSession, table: str, parts: list | None = None, version: str | None = None) -> DataFrame:
    """Rows of the newest version, of some partitions only if `parts` gives their values; `version` names a column for each row's
    version, that in which its file was written. Only file names pass through the driver, as in any listing."""
    _, _, schema, listed = _manifest(spark, table)
    if parts is not None:
        listed = listed.where(F.when(F.col("part").isNull(), F.lit(None in parts)).otherwise(F.col("part").isin([str(p) for p in parts if p is not None])))
    out = _rows(spark, schema, sorted(r["file"] for r in listed.select("file").collect()))
    return out.drop(VERSION) if version is None else out.withColumnRenamed(VERSION, version)


def replace(spark: SparkSession, table: str, new: DataFrame) -> int:
    """A version in which the partitions that `new` has rows for hold those rows, and all others keep their files."""
    version, part, schema, listed = _manifest(spark, table)
    added = _write(new.select(schema.names), table, part, version + 1)
    kept = listed.alias("a").join(added.select("part").distinct().alias("b"), F.col("a.part").eqNullSafe(F.col("b.part")), "left_anti")
    _publish(kept.unionByName(added), table, part, schema, version + 1)
    return version + 1


def upsert(spark: SparkSession, table: str, new: DataFrame, keys: list[str]) -> int:
    """A version with the rows of `new`, and those of before whose keys it doesn't have. Null keys are equal.

    The partition must follow from the keys: only partitions that `new` has rows for are read and written anew. Repeated keys in
    `new` stay repeated.
    """
    _, part, schema, listed = _manifest(spark, table)
    touched = new.select(F.col(part).cast("string").alias("part")).distinct()
    paths = listed.alias("a").join(touched.alias("b"), F.col("a.part").eqNullSafe(F.col("b.part")), "left_semi").select("file")
    old = _rows(spark, schema, sorted(r["file"] for r in paths.collect())).drop(VERSION)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rest = old.alias("a").join(new.select(keys).alias("b"), same, "left_anti")
    return replace(spark, table, rest.unionByName(new.select(schema.names)))
