"""What grows with the input stays in tasks, and sums don't depend on their order."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from surveyloom.operators import estimate, pixels, raster, series
from surveyloom.plans import registry


def test_draws_are_merged_not_broadcast(spark):
    households = spark.range(400).select(F.col("id").alias("h"), F.lit("a").alias("s"))
    sums = spark.range(400).select(F.col("id").alias("h"), F.lit(1.0).alias("x"))
    out = estimate.drawn(sums, estimate.bootstrap_draws(households, "h", "s", 50), "h")
    assert sum(r["x"] * r["m"] for r in out.select("x", "m").collect()) == 20000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [h#" in plan and "BroadcastHashJoin [h#" not in plan


def test_ranks_of_values_that_change_when_computed_anew(spark):
    """Like sums of doubles, whose last digits follow the order of a shuffle."""
    noise = F.udf(lambda: random.random(), "double").asNondeterministic()
    out = series.ranked(spark.range(20).select(F.lit("a").alias("g"), noise().alias("v")), ["g"], "v").collect()
    assert sorted(r["rank"] for r in out) == [float(i) for i in range(1, 21)]


def test_overlay_of_part_numbers_above_a_million(spark, tmp_path):
    registry.load()
    spark.createDataFrame([(i, f"p{i}", "t", 3) for i in (2, 3, 1000002)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "s")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["id"]: r["slug"] for r in registry.QUERIES["b08_overlay"](spark, str(tmp_path)).collect()}
    assert got == {2: "slug-2", 3: None, 1000002: None, 1000007: None}


def test_steps_in_one_tile_shuffle_the_layers_alone(spark):
    pick = random.Random(3)
    seeds, holes = ([(0, pick.randrange(-20, 600), pick.randrange(600)) for _ in range(n)] for n in (60, 20))
    a, b = (spark.createDataFrame(x, "year int, row int, col int") for x in (seeds, holes))
    one = raster.combined([a, b], 9 + 4 + 4, lambda s, h: raster.near(raster.deep(raster.near(s, 9) & ~raster.near(h, 2), 4), 4))
    steps = pixels.dilate(pixels.erode(pixels.dilate(a, 9, True).join(pixels.dilate(b, 2, True), raster.PLACE, "left_anti"), 4, True), 4, True)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in steps.collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_mining_mask_joins_no_widened_places(spark):
    a = spark.createDataFrame([(0, 5, 5)], "year int, row int, col int")
    out = pixels.mining_mask(a, a, a.where("false"), 1, 2)
    assert out.count() == 5 and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_inverted_index_shuffles_texts_once(spark, tmp_path):
    registry.load()
    spark.createDataFrame([(1, "b a  b"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["f05_inverted_index"](spark, str(tmp_path))
    got = {r["doc_id"]: r["texto"] for r in out.collect()}
    assert got[1] == "b a b" and set(got) == {1, 2, 3}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1 and out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_replicates_of_all_cells_are_summed_in_one_pass(spark):
    households = spark.range(300).select(F.col("id").alias("h"), (F.col("id") % 3).cast("string").alias("s"))
    odd = F.when(F.col("id") == 7, F.lit(float("inf"))).when(F.col("id") % 10 == 3, None).otherwise(F.col("id") * 0.5)
    rows = spark.range(2000).select((F.col("id") % 301).alias("h"), (F.col("id") % 7).alias("c"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), odd.alias("_x"), F.lit(1.0).alias("_d"))
    got = estimate.replicate_sums(rows, estimate.bootstrap_draws(households, "h", "s", 20), ["c", "k"], "h")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode(draws" not in plan
    want = estimate.replicate_sums(rows, estimate.bootstrap_weights(households, "h", "s", 20), ["c", "k"], "h")
    both = [{(r["c"], r["k"], r["b"]): [None if v is None else round(v, 6) for v in (r["_x"], r["_d"])] for r in t.collect() if (r["_x"], r["_d"]) != (None, None)} for t in (got, want)]
    assert both[0] == both[1] and len(both[0]) > 600


def test_draws_are_shuffled_packed(spark):
    sizes = {"a": 1, "b": 2, "c": 1500}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    out = estimate.bootstrap_draws(spark.createDataFrame(rows, "h string, s string"), "h", "s", 5)
    got = {(r["h"], e % estimate.DRAWN): e // estimate.DRAWN * r["scale"] for r in out.collect() for e in r["draws"]}
    want = {("a0", b): 1.0 for b in range(5)}
    for s, n in (("b", 2), ("c", 1500)):
        order = sorted((h for h, t in rows if t == s), key=lambda h: (hashlib.md5(h.encode()).hexdigest(), h))
        hits = Counter((order[int(hashlib.md5(f"1|{s}|{b}|{r}".encode()).hexdigest()[:15], 16) % n], b) for b in range(5) for r in range(1, n))
        want |= {k: c * n / (n - 1) for k, c in hits.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_composite_is_one_pass_without_object_aggregates(spark):
    """Medians by pixel were aggregates of objects, sorted by each of many pixels."""
    pick = random.Random(4)
    odd = [None, 0.0, -1.5, float("nan"), float("inf"), 1e300]
    rows = [(pick.choice([None, 1990, 1991]), pick.choice([None, -70, -1, 0, 63, 64]), pick.randrange(3), pick.choice(odd + [pick.random()] * 6), pick.choice([None, 1, 2, 7])) for _ in range(600)]
    rows += [(1995, 9, 9, None, None)]
    obs = spark.createDataFrame(rows, "year int, row int, col int, a double, b int")
    out = pixels.composite(obs, ["a", "b"])
    want = obs.groupBy("year", "row", "col").agg(F.median("a").alias("a"), F.median("b").alias("b"), F.count("a").alias("n_obs"))
    assert out.dtypes == want.dtypes
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
