"""Tables written to the cluster's shared folder, to cut lineage between steps and the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only in local mode, where there's but one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later uses don't recompute, and lost executors don't matter."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `stored` that no later step reads."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tables/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1].lstrip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
