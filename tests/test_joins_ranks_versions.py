"""Nearest places, concave zones, ranks, decompositions and stored versions against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import analysis, joins, series
from surveyloom.sources import versions

POINTS = "g string, k long, x double, y double"


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    right = [("a", i, rng.gauss(0, 0.3) + 50, rng.gauss(0, 0.3)) for i in range(400)]  # a cluster far from most
    right += [("a", 400 + i, rng.uniform(0, 100), rng.uniform(-50, 50)) for i in range(300)]
    right += [("a", 900 + i, 7.0, 7.0) for i in range(50)] + [("b", 1000 + i, float(i % 3), 0.0) for i in range(40)]  # ties
    right += [("d", 2000 + i, 1.0, float(i)) for i in range(70)] + [(None, 1, 0.0, 0.0), ("a", 9999, None, 1.0), ("a", 9998, float("nan"), 1.0)]
    left = [("a", i, rng.uniform(-20, 120), rng.uniform(-70, 70)) for i in range(150)] + [("b", 200, 1.5, 2.0), ("b", 201, 1.0, 0.0), ("b", 201, 1.0, 0.0)]
    left += [("c", 300, 0.0, 0.0), ("d", 301, 1.0, 33.4), ("a", 302, 7.0, 7.0), (None, 303, 0.0, 0.0), ("a", 304, 0.0, None)]
    got = joins.nearest_in_group(spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS).withColumnRenamed("k", "o"), "g", "k", "o", "x", "y").collect()
    want = {}
    for g, k, x, y in left:
        near = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), o) for h, o, u, v in right if h == g and u is not None and u == u] if g and y is not None else []
        if near:
            want[g, k] = min(near)
    assert len(got) == len(want)
    for r in got:
        d, o = want[r["g"], r["k"]]
        assert r["o"] == o and r["distance"] == pytest.approx(d, abs=1e-12)
    none = spark.createDataFrame([], POINTS)
    assert joins.nearest_in_group(none, spark.createDataFrame(right, POINTS).withColumnRenamed("k", "o"), "g", "k", "o", "x", "y").count() == 0
    assert joins.nearest_in_group(spark.createDataFrame(left, POINTS), none.withColumnRenamed("k", "o"), "g", "k", "o", "x", "y").count() == 0


def test_nearest_by_blocks_of_any_size(spark, monkeypatch):
    """Places were sent down the tree one by one, with all the cells in question."""
    rng = random.Random(6)
    right = [("a", i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(900)] + [("a", 900 + i, 0.5, 0.5) for i in range(9)]
    left = [("a", i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(600)] + [("a", 600 + i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    a, b = spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS).withColumnRenamed("k", "o")
    want = {k: min((math.sqrt((x - u) ** 2 + (y - v) ** 2), o) for _, o, u, v in right) for _, k, x, y in left}
    calls = []
    descend = joins._descend
    monkeypatch.setattr(joins, "_descend", lambda blocks, levels, most: calls.append(blocks.count()) or descend(blocks, levels, most))
    for few, blocks, cells in ((64, (512, 16), 512), (4, (64, 8), 60)):
        monkeypatch.setattr(joins, "FEW", few), monkeypatch.setattr(joins, "BLOCKS", blocks), monkeypatch.setattr(joins, "CELLS", cells)
        calls.clear()
        got = {r["k"]: (r["distance"], r["o"]) for r in joins.nearest_in_group(a, b, "g", "k", "o", "x", "y").collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
        assert calls[0] < 100 and len(calls) == (1 if few == 64 else 3)


def _holds(ring, x, y):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def test_concave_zones_equal_brute_force(spark):
    rng = random.Random(11)
    star = lambda cx, cy, n, a, b: [(cx + (a if i % 2 else b) * math.cos(math.pi * i / n), cy + (a if i % 2 else b) * math.sin(math.pi * i / n)) for i in range(2 * n)]
    rings = {"star": star(3.3, -2.1, 7, 9.0, 2.5), "tiny": star(0.01, 0.02, 5, 0.013, 0.004), "wide": [(-30.0, -1.0), (40.0, -1.5), (40.0, 0.2), (-30.0, 0.1)], "bow": [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 8.0)]}
    flat = {"line": [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)], "two": [(0.0, 0.0), (5.0, 5.0)], "no": []}
    zones = spark.createDataFrame(list((rings | flat).items()) + [(None, rings["star"])], "zone string, ring array<struct<x: double, y: double>>")
    places = [(i, rng.uniform(-12, 14), rng.uniform(-12, 14)) for i in range(400)] + [(500 + i, rng.uniform(-0.01, 0.03), rng.uniform(-0.01, 0.04)) for i in range(100)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    got = joins.point_in_zone(spark.createDataFrame(places, "p long, x double, y double"), zones, "x", "y", "zone", "ring").collect()
    want = [(p, z) for p, x, y in places if x is not None and x == x for z, r in [*rings.items(), (None, rings["star"])] if _holds(r, x, y)]
    assert sorted(((r["p"], r["zone"]) for r in got), key=str) == sorted(want, key=str)
    sizes = {d: joins.zone_cover(zones.where("zone = 'star'"), "zone", "ring", d).where("edges is not null").count() for d in (6, 8)}
    assert sizes[8] < 5 * sizes[6]  # two halvings: four times the border cells, not sixteen


def test_ranks_of_one_group_meet_in_many_tasks(spark):
    rows = [("a", i, float(i * 7 % 40)) for i in range(300)] + [("b", i, 1.0) for i in range(5)] + [(None, 1, 2.0), (None, 2, 1.0), ("a", 999, None)]
    got = {(r["g"], r["k"]): r["rank"] for r in series.ranked(spark.createDataFrame(rows, "g string, k long, v double"), ["g"], "v").collect()}
    for g, k, v in rows:
        if v is None:
            assert (g, k) not in got
        else:
            own = [u for h, _, u in rows if h == g and u is not None]
            assert got[g, k] == sum(u < v for u in own) + (sum(u == v for u in own) + 1) / 2
    assert series.ranked(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_gradients(spark):
    rows = [("a", float(i), 3.0 * i + 1) for i in range(9)] + [("b", 1.0, 2.0)] * 4 + [("c", 1.0, float(i)) for i in range(6)] + [("a", None, 1.0)]
    got = {r["g"]: r for r in analysis.gradients(spark.createDataFrame(rows, "g string, a double, v double"), ["g"], "v", "a").collect()}
    assert (got["a"]["n"], round(got["a"]["slope"], 9), round(got["a"]["spearman"], 9)) == (9, 3.0, 1.0)
    assert got["b"]["slope"] is None and got["b"]["spearman"] is None and got["c"]["spearman"] is None


def test_decomposition_equals_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) + 5
    side, w = rng.random(400) < 0.4, rng.uniform(0.5, 3, 400)
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + side * (x[:, 1] + 3) + rng.normal(size=400)
    rows = [(*map(float, a), float(b), float(c), bool(s)) for a, b, c, s in zip(x, y, w, side)] + [(1.0, None, 1.0, 1.0, 5.0, 1.0, True), (1.0, 1.0, 1.0, 1.0, 5.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, w double, s boolean")
    out = analysis.oaxaca(df, "y", ["a", "b", "c", "d"], "w", F.col("s")).first()

    def fit(own):
        design, root = np.c_[np.ones(own.sum()), x[own]], np.sqrt(w[own])
        beta = np.linalg.lstsq(design * root[:, None], y[own] * root, rcond=None)[0]
        return np.average(design, axis=0, weights=w[own]), beta

    (ma, ba), (mb, bb) = fit(side), fit(~side)
    assert out["gap"] == pytest.approx(ma @ ba - mb @ bb) and out["endowments"] == pytest.approx((ma - mb) @ bb)
    assert out["coefficients"] == pytest.approx(mb @ (ba - bb)) and out["interaction"] == pytest.approx((ma - mb) @ (ba - bb))
    assert out["pct_explained"] == pytest.approx(100 * out["endowments"] / out["gap"]) and (out["n_a"], out["n_b"]) == (side.sum(), (~side).sum())
    assert [t["name"] for t in out["terms"]] == ["a", "b", "c", "d"] and sum(t["endowment"] for t in out["terms"]) == pytest.approx(out["endowments"])
    twice = analysis.oaxaca(df.dropna().withColumn("e", F.col("a") * 2), "y", ["a", "e"], "w", F.col("s")).first()  # collinear
    assert twice["gap"] == pytest.approx(out["gap"]) and twice["endowments"] is None and twice["terms"] is None
    empty = analysis.oaxaca(df.limit(0), "y", ["a", "b"], "w", F.col("s")).first()
    assert empty["gap"] is None and empty["n_a"] == 0


def test_stored_versions(spark):
    rows = [(i, i % 4 if i % 4 < 3 else None, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, p int, v string")
    table = versions.create(df, versions.unused(spark), "p")
    before = {(r["part"], r["file"]) for r in versions.files(spark, table).collect()}
    versions.upsert(spark, table, spark.createDataFrame([(1, 1, "new"), (101, 1, "added"), (3, None, "none")], df.schema), ["k", "p"])
    after = {(r["part"], r["file"]) for r in versions.files(spark, table).collect()}
    assert {f for f in before if f[0] in ("0", "2")} == {f for f in after if f[0] in ("0", "2")}
    assert not {f for f in before if f[0] not in ("0", "2")} & after
    want = sorted([(k, p, {1: "new", 3: "none"}.get(k, v)) for k, p, v in rows] + [(101, 1, "added")], key=str)
    assert sorted(map(tuple, versions.read(spark, table).collect()), key=str) == want
    assert {r["k"] for r in versions.read(spark, table, parts=[None]).collect()} == {k for k, p, _ in rows if p is None}
    assert {(r["p"], r["n"]) for r in versions.read(spark, table, version="n").select("p", "n").distinct().collect()} == {(0, 1), (1, 2), (2, 1), (None, 2)}
    # A write that is lost before its manifest is published changes nothing.
    versions._write(df.withColumn("v", F.lit("lost")), table, "p", 3)
    assert sorted(map(tuple, versions.read(spark, table).collect()), key=str) == want
    # A second writer of a version that exists fails and leaves the table as it is.
    with pytest.raises(Exception, match="(?i)exist"):
        versions._publish(versions.files(spark, table), table, "p", df.schema, 2)
    assert versions.replace(spark, table, df.limit(0)) == 3 and versions.read(spark, table).count() == 41
    void = versions.create(df.limit(0), versions.unused(spark), "p")
    assert versions.read(spark, void).count() == 0 and versions.read(spark, void).columns == ["k", "p", "v"]
    versions.upsert(spark, void, df, ["k"])
    assert versions.read(spark, void).count() == 40
