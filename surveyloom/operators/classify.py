"""Reference labels, samples with quotas, and the forest classifier of pixel tables."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pixels import PLACE, dilate, erode


def reference_labels(products: DataFrame, positive: Column, any_sign: Column, excluded: Column, keep_out: int = 3) -> DataFrame:
    """(year, row, col, label) from several products joined by pixel.

    Positive pixels are those of the core of their area (one pixel eroded); negative ones lie further than `keep_out` pixels from
    any sign of the class and aren't excluded; the rest have no label.
    """
    sure = erode(products.where(F.coalesce(positive, F.lit(False))).select(*PLACE), 1)
    near = dilate(products.where(F.coalesce(any_sign, F.lit(False))).select(*PLACE), keep_out)
    free = products.where(~F.coalesce(excluded, F.lit(False))).select(*PLACE).join(near, PLACE, "left_anti")
    yes = products.select(*PLACE).join(sure, PLACE, "left_semi")
    return yes.withColumn("label", F.lit(1)).unionByName(free.withColumn("label", F.lit(0)))


def stable(grid: DataFrame, cls: str, years: int) -> DataFrame:
    """(row, col, class) of pixels that have one class in all of `years` years."""
    seen = grid.groupBy("row", "col").agg(F.min(cls).alias("class"), F.max(cls).alias("_h"), F.count_distinct("year").alias("_n"))
    return seen.where((F.col("class") == F.col("_h")) & (F.col("_n") == years)).select("row", "col", "class")


def quota_sample(df: DataFrame, stratum: str, key: Column, quotas: dict, order: list) -> DataFrame:
    """Rows of each stratum by hash order up to its quota; what a stratum can't fill goes to the next in `order`.

    Counts of strata (a handful) decide the quotas; rows are ranked in 256 parts a stratum, so a large one isn't one task's.
    """
    spark = df.sparkSession
    counts = {r[stratum]: r["count"] for r in df.where(F.col(stratum).isin(order)).groupBy(stratum).count().collect()}
    rows, left = [], 0
    for s in order:
        want = quotas[s] + left
        take = min(want, counts.get(s, 0))
        left = want - take
        rows.append((s, take))
    table = spark.createDataFrame(rows, f"_s {dict(df.dtypes)[stratum]}, _take long")
    hashed = df.withColumn("_h", F.md5(key.cast("string"))).withColumn("_p", F.substring("_h", 1, 2))
    parts = hashed.groupBy(stratum, "_p").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(stratum, "_p", ahead.alias("_a"))
    inside = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h"))
    ranked = hashed.withColumn("_i", inside).join(parts, [stratum, "_p"]).join(F.broadcast(table), F.col(stratum) == F.col("_s"))  # a row per stratum
    return ranked.where(F.col("_a") + F.col("_i") <= F.col("_take")).select(df.columns)


def train(rows: DataFrame, features: list[str], label: str, trees: int = 60, seed: int = 7) -> RandomForestClassificationModel:
    """A forest with classes weighted equally; rows with a missing feature are left out."""
    known = rows.dropna(subset=[*features, label])
    n = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # two classes
    total = sum(n.values())
    weight = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(total / (len(n) * v)))])
    ready = VectorAssembler(inputCols=features, outputCol="_x").transform(known.withColumn("_w", weight[F.col(label)]).withColumn("_y", F.col(label).cast("double")))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=5, maxDepth=12, seed=seed)
    return forest.fit(ready)


def probabilities(model: RandomForestClassificationModel, rows: DataFrame, features: list[str], cut: float = 0.5) -> DataFrame:
    """rows with probability (of class 1) and flag; both null where a feature is missing."""
    filled = rows.withColumn("_ok", F.forall(F.array(*[F.col(f).isNotNull() for f in features]), lambda x: x)).fillna(0.0, features)
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(filled))
    p = F.when(F.col("_ok"), vector_to_array("probability")[1])
    columns = [F.when(F.col("_ok") | ~F.lit(c in features), F.col(c)).alias(c) for c in rows.columns]
    return scored.select(*columns, p.alias("p")).withColumn("flag", F.col("p") >= cut)


def block_metrics(rows: DataFrame, features: list[str], label: str, fold: str, folds: int, trees: int = 20) -> DataFrame:
    """(fold, n, accuracy, f1): each fold of spatial blocks scored by a forest of the others. A loop over a few folds."""
    out = None
    for k in range(folds):
        model = train(rows.where(F.col(fold) != k), features, label, trees)
        held = probabilities(model, rows.where(F.col(fold) == k), features).where("flag is not null")
        hit, yes, own = F.col("flag") == (F.col(label) == 1), F.col("flag"), F.col(label) == 1
        one = held.agg(
            F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"),
            F.try_divide(2 * F.count_if(yes & own), 2 * F.count_if(yes & own) + F.count_if(yes != own)).alias("f1"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def importances(model: RandomForestClassificationModel, features: list[str], like: DataFrame) -> DataFrame:
    pairs = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return like.sparkSession.createDataFrame(pairs, "feature string, importance double")
