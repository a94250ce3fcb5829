"""The library's own operators: null rules, worked examples and invariants that the SQL oracles don't reach."""

import pytest
from pyspark.sql import functions as F

from surveyloom.functions import profile as P
from surveyloom.functions import recode as R
from surveyloom.operators import analysis, estimate, linkage, measures, migration, pixels, series
from surveyloom.sources import files


def test_bands_and_nulls(spark):
    df = spark.createDataFrame([(None,), (0,), (4,), (79,), (80,), (104,)], "age int")
    assert [r[0] for r in df.select(R.age_band(F.col("age"))).collect()] == [None, "00_04", "00_04", "75_79", "80_mais", "80_mais"]
    flags = spark.createDataFrame([(True, True, True), (True, None, True), (False, False, False), (True, False, False)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in flags.select(R.adequacy(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["adequada", None, "inadequada", "semi_adequada"]
    numbers = spark.createDataFrame([("1.234,56",), ("x",), (None,)], "t string")
    assert [r[0] for r in numbers.select(R.locale_number(F.col("t"))).collect()] == [1234.56, None, None]
    halves = spark.createDataFrame([(25.0,), (35.0,)], "x double")
    assert [r[0] for r in halves.select(R.round_to(F.col("x"))).collect()] == [20.0, 40.0]


def test_last_stage_is_not_asked_in_2000():
    with pytest.raises(NotImplementedError):
        migration.last_stage_type(2000, None, None, None, None)


def test_bootstrap_draws(spark):
    households = spark.createDataFrame([(i, "a" if i < 9 else "b" if i < 14 else "c") for i in range(15)], "h long, s string")
    w = estimate.bootstrap_weights(households, "h", "s", 10).join(households, "h")
    for r in w.groupBy("s", "b").agg(F.sum("m").alias("m")).collect():
        assert r["m"] == pytest.approx({"a": 9, "b": 5, "c": 1}[r["s"]])


def test_accuracy_worked_example(spark):
    strata = spark.createDataFrame([(32710, True, 40, 31), (72893, False, 45, 2), (548732, False, 46, 0)], "n_h long, map boolean, n long, hits long")
    r = pixels.accuracy(strata, 0.09).first()
    assert (round(r["overall"], 4), round(r["users"], 4), round(r["producers"], 4)) == (0.9838, 0.775, 0.8867)
    assert round(r["area_ha"], 1) == 2573.1 and abs(r["half_ha"] - 555.4) < 0.1


def test_differences_worked_example(spark):
    cube = [("x", 1, "i", 0.0, 0.0), ("x", 2, "i", 16.4, 2.6724), ("y", 1, "i", 0.0, 0.0), ("y", 2, "i", 2.62, 1.242)]
    r = analysis.did(spark.createDataFrame(cube, "unit string, wave int, indicator string, value double, se double"), "x", ["y"], [(1, 2), (2, 3)]).collect()
    assert [(round(x["did"], 2), round(x["se"], 4), x["significant"]) for x in r] == [(13.78, 2.9469, True)]


def test_dictionary_round_trip(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", "x"), (3, None, "x")], "k int, p string, q string")
    dictionary, coded = linkage.dictionary_encode(df, ["p", "q"])
    assert sorted(linkage.dictionary_decode(dictionary, coded, ["p", "q"]).collect(), key=str) == sorted(df.collect(), key=str)


def test_patches_and_groups(spark):
    mask = spark.createDataFrame([(1, r, c) for r, c in [(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)]] + [(2, 0, 0)], "year int, row int, col int")
    got = {(r["year"], r["row"], r["col"]): r["patch"] for r in pixels.patches(mask, 10).collect()}
    assert got == {(1, 0, 0): 0, (1, 1, 1): 0, (1, 2, 2): 0, (1, 5, 5): 55, (1, 5, 6): 55, (1, 9, 0): 90, (2, 0, 0): 0}
    records = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "b", ""), (4, None, "")], "k long, i string, t string")
    assert {r["k"]: r["group"] for r in linkage.group_records(records, "k", ["i", "t"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_entries_without_training_data(spark, monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setattr(entry, "_llm", None)
    assert entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert entry.entry(spark).count() > 0


def test_profile_null_rules(spark):
    df = spark.createDataFrame([("2", "05", "05", 20), ("2", "", "05", 9), ("2", None, "05", None), ("3", None, None, 40)], "a string, b string, s string, age int")
    assert [r[0] for r in df.select(P.birthplace(F.col("a"), F.col("b"), F.col("s"))).collect()] == ["mesma_uf", None, None, "exterior"]
    assert [r[0] for r in df.select(P.implied_false(F.col("b") == "05", F.col("a") == "3", F.col("age") < 10)).collect()] == [True, None, None, False]
    labels = spark.createDataFrame([("outros:a+z",), ("a",), (None,)], "c string").select(P.fused_label(F.col("c"), {"a": "Alfa"}))
    assert [r[0] for r in labels.collect()] == ["Outros (Alfa, z)", "Alfa", ""]
    years = spark.createDataFrame([(1984,), (1985,), (2022,), (2023,), (None,)], "y int").select(P.arrival_period(F.col("y")))
    assert [r[0] for r in years.collect()] == ["ate_1984", "1985_1994", "2017_2022", None, None]
    with pytest.raises(LookupError):
        P.concept({"renda": {1991: None}}, "renda", 1991)


def test_text_from_inverted_index(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0, 2]},), ({},), (None,)], "i map<string,array<int>>")
    assert [r[0] for r in df.select(P.text_from_index(F.col("i"))).collect()] == ["a b a b", "", None]


def test_running_group_over_many_ranges(spark):
    rows = [(i, i % 7 in (0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s boolean").repartition(8)
    got = {r["k"]: r["g"] for r in series.running_group(df, ["k"], F.col("s"), "g").collect()}
    n = 0
    for k, s in rows:
        n += s
        assert got[k] == n
    assert series.running_group(df.where("k < 0"), ["k"], F.col("s"), "g").count() == 0


def test_quantile_row_sums_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 1.0), ("b", None, 1.0)], "g string, v double, w double")
    assert [tuple(r) for r in series.quantile_row(df, ["g"], "v", "w", 0.5).collect()] == [("a", 2.0)]


def test_slope_and_mosaic(spark):
    grid = spark.createDataFrame([(r, c, 30.0 * c) for r in range(3) for c in range(3)], "r int, c int, z double")
    got = {(x["r"], x["c"]): x["slope"] for x in measures.slope_degrees(grid, "r", "c", "z", 30.0).collect()}
    assert got[1, 1] == pytest.approx(45.0) and sum(v is not None for v in got.values()) == 1
    tiles = spark.createDataFrame([(1, 1, 5.0), (1, 2, 0.0), (1, 1, 7.0), (2, 1, 0.0)], "p int, t int, v double")
    assert [tuple(r) for r in measures.mosaic(tiles, ["p"], "v", ["t"], F.col("v") > 0).collect()] == [(1, 7.0)]


def test_fixed_width_round_trip(spark, tmp_path):
    layout = {"id": (0, 4), "name": (4, 9)}
    df = spark.createDataFrame([(1, "ção"), (2, None), (None, " a ")], "id int, name string")
    files.write_fixed_width(df, f"{tmp_path}/fixed", layout)
    got = files.read_fixed_width(spark, f"{tmp_path}/fixed", layout, ["name", "id"])
    assert sorted(map(tuple, got.collect())) == [("     ", "2   "), (" a   ", "    "), ("ção  ", "1   ")]
    with pytest.raises(KeyError):
        files.read_fixed_width(spark, f"{tmp_path}/fixed", layout, ["age"])
    with pytest.raises(Exception, match="too long"):
        files.write_fixed_width(df.selectExpr("123456 as id", "name"), f"{tmp_path}/long", layout)
