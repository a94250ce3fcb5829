"""Pixel neighbourhoods, patches, samples, joins and sources against plain Python."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import classify, joins, linkage, pixels, raster
from surveyloom.operators.graph import components
from surveyloom.sources import records


def places(df):
    return {(r["year"], r["row"], r["col"]) for r in df.collect()}


@pytest.fixture(scope="module")
def mask(spark):
    pick = random.Random(2)
    return spark.createDataFrame([(y, r, c) for y in (1, 2) for r in range(20) for c in range(12) if pick.random() < 0.55], "year int, row int, col int")


def flood(cells, sides):
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (sides == 8 or not (i and j))]
    left, out = set(cells), []
    while left:
        todo, own = deque([left.pop()]), set()
        while todo:
            y, r, c = todo.popleft()
            own.add((y, r, c))
            for i, j in steps:
                if (y, r + i, c + j) in left:
                    left.discard((y, r + i, c + j))
                    todo.append((y, r + i, c + j))
        out.append(own)
    return out


@pytest.mark.parametrize("sides", [4, 8])
def test_patches(mask, sides):
    got = {}
    for r in pixels.patches(mask, 12, sides).collect():
        got.setdefault((r["year"], r["patch"]), set()).add((r["year"], r["row"], r["col"]))
    want = flood(places(mask), sides)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(p == min(r * 12 + c for _, r, c in own) for (_, p), own in got.items())


def test_small_patches_and_holes(mask):
    cells = places(mask)
    assert places(pixels.drop_small(mask, 12, 4)) == {x for own in flood(cells, 8) if len(own) >= 4 for x in own}
    other = {(y, r, c) for y in (1, 2) for r in range(20) for c in range(12)} - cells
    holes = [own for own in flood(other, 4) if len(own) <= 3 and not any(r in (0, 19) or c in (0, 11) for _, r, c in own)]
    assert holes and places(pixels.fill_holes(mask, 20, 12, 3)) == cells | {x for own in holes for x in own}


def test_neighbourhoods(spark, mask):
    cells = places(mask)
    disc = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    assert places(pixels.dilate(mask, 2, disc=True)) == {(y, r + i, c + j) for y, r, c in cells for i, j in disc}
    assert places(pixels.erode(mask, 1)) == {(y, r, c) for y, r, c in cells if all((y, r + i, c + j) in cells for i in (-1, 0, 1) for j in (-1, 0, 1))}
    grid = spark.createDataFrame([(1, r, c, float((r * 7 + c * 3) % 11)) for r in range(6) for c in range(5)], "year int, row int, col int, v double")
    value = {(r["row"], r["col"]): r["v"] for r in grid.collect()}

    def mirrored(x, n):
        return -x - 1 if x < 0 else 2 * n - 1 - x if x >= n else x

    for k in (3, 5):
        for r in pixels.local_std(grid, "v", k, 6, 5).collect():
            h = k // 2
            own = [value[mirrored(r["row"] + i, 6), mirrored(r["col"] + j, 5)] for i in range(-h, h + 1) for j in range(-h, h + 1)]
            m = sum(own) / len(own)
            assert r["std"] == pytest.approx((sum((x - m) ** 2 for x in own) / len(own)) ** 0.5)


@pytest.mark.parametrize("reach,disc", [(3, True), (8, True), (33, True), (100, True), (5, False), (33, False)])
def test_distances_at_radii(spark, reach, disc):
    """Every place within reach and its distance, by brute force; across tiles and below zero."""
    rng = np.random.default_rng(reach)
    side = max(raster.TILE, 2 * reach + 2)
    cells = np.unique(np.concatenate([rng.integers(-20, side + 20, (7, 2)), [[side - 1, side - 1], [side, 3], [-1, 0]]]), axis=0)
    mask = spark.createDataFrame([(y, int(r), int(c)) for y in (1, 2) for r, c in (cells if y == 1 else cells[:3])], "year int, row int, col int")
    got = {(r["year"], r["row"], r["col"]): r["d2"] for r in raster.distances(mask, reach, disc).collect()}
    want = {}
    for y, own in ((1, cells), (2, cells[:3])):
        for r0, c0 in own.tolist():
            i, j = np.mgrid[-reach : reach + 1, -reach : reach + 1]
            d2 = i * i + j * j if disc else np.maximum(i * i, j * j)
            for a, b, d in zip((i + r0).ravel().tolist(), (j + c0).ravel().tolist(), d2.ravel().tolist()):
                if d <= reach * reach:
                    want[y, a, b] = min(d, want.get((y, a, b), d))
    assert got == want


@pytest.mark.parametrize("reach", [2, 9, 33])
def test_erosion_at_radii(spark, reach):
    rng = np.random.default_rng(reach)
    dense = np.ones((90, 300), bool)
    dense[rng.integers(0, 90, 4), rng.integers(0, 300, 4)] = False
    mask = spark.createDataFrame([(1, int(r), int(c)) for r, c in np.argwhere(dense)], "year int, row int, col int")
    padded = np.pad(dense, reach)
    keep = np.ones_like(dense)
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            if i * i + j * j <= reach * reach:
                keep &= padded[reach + i : reach + i + 90, reach + j : reach + j + 300]
    assert {(r, c) for _, r, c in places(pixels.erode(mask, reach, disc=True))} == set(map(tuple, np.argwhere(keep).tolist()))


def test_runs_cross_tiles(spark):
    """A row longer than a tile is one patch; repeats of a place count once."""
    rows = [(1, 0, c) for c in range(700)] + [(1, 1, 699), (1, 3, 5), (1, 3, 5)]
    own = raster.patch_runs(spark.createDataFrame(rows, "year int, row int, col int"), 1000).collect()
    assert len(own) == 5 and {r["patch"] for r in own} == {0, 3005}
    sizes = raster.sizes(raster.patch_runs(spark.createDataFrame(rows, "year int, row int, col int"), 1000))
    assert {r["patch"]: r["size"] for r in sizes.collect()} == {0: 701, 3005: 1}


@pytest.mark.parametrize("reach", [1.5, 6, 33, 300])
def test_near_patches_at_reaches(spark, reach):
    rng = np.random.default_rng(int(reach))
    cells = {(int(r), int(c)) for r, c in rng.integers(0, 620, (220, 2))} | {(100, c) for c in range(200, 530)}
    patched = pixels.patches(spark.createDataFrame([(1, r, c) for r, c in sorted(cells)], "year int, row int, col int"), 700)
    by = {}
    for r in patched.collect():
        by.setdefault(r["patch"], []).append((r["row"], r["col"]))
    names, arrays = sorted(by), {k: np.array(v) for k, v in by.items()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            d = np.sqrt(((arrays[a][:, None] - arrays[b][None]) ** 2).sum(2).min())
            if d <= reach:
                want[a, b] = pytest.approx(d)
    assert {(r["a"], r["b"]): r["distance"] for r in pixels.near_patches(patched, reach).collect()} == want


def test_seal_keeps_lone_positives(spark):
    flags = spark.createDataFrame([(y, 0, 0, f) for y, f in enumerate([True, False, True, True, False])], "year int, row int, col int, f boolean")
    assert [r["sealed"] for r in pixels.seal(flags, "f").orderBy("year").collect()] == [True, False, True, True, True]


def test_core_chain(spark):
    rows = [(1, 0, c) for c in (0, 1, 3, 4, 7, 20)] + [(1, 9, 9)]
    patched = pixels.patches(spark.createDataFrame(rows, "year int, row int, col int"), 30)
    got = {(r["row"], r["col"]) for r in pixels.core_chain(patched, 0, 0, 2, 10, 3).collect()}
    assert got == {(0, 0), (0, 1), (0, 3), (0, 4)}
    assert {(r["row"], r["col"]) for r in pixels.core_chain(patched, 0, 0, 3, 10, 3).collect()} == got | {(0, 7)}
    core = pixels.core_chain(patched, 0, 0, 2, 10, 3)
    near = {r["patch"]: (r["size"], r["distance"], r["near"]) for r in pixels.small_and_near(patched, core, 4, 1).collect()}
    assert near == {7: (1, 3.0, True), 20: (1, None, False), 279: (1, None, False)}


def test_quota_sample_carries_over(spark):
    rows = [("a", i) for i in range(30)] + [("b", i) for i in range(400)] + [("c", i) for i in range(5)]
    df = spark.createDataFrame(rows, "s string, k long")
    got = classify.quota_sample(df, "s", F.col("k"), {"a": 100, "b": 50, "c": 20}, ["a", "b", "c"]).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 30, "b": 120, "c": 5}


def test_forest_finds_the_rule(spark):
    pick = random.Random(4)
    rows = [(x := pick.random(), pick.random(), int(x > 0.4), i % 3) for i in range(600)]
    df = spark.createDataFrame([*rows, (None, 0.5, 1, 0)], "x double, z double, y int, fold int")
    model = classify.train(df, ["x", "z"], "y", 10)
    out = classify.probabilities(model, df, ["x", "z"]).collect()
    assert sum(r["flag"] == (r["y"] == 1) for r in out if r["x"] is not None) >= 590
    assert [(r["p"], r["flag"], r["x"]) for r in out if r["x"] is None] == [(None, None, None)]
    assert all(r["accuracy"] > 0.93 for r in classify.block_metrics(df, ["x", "z"], "y", "fold", 3, 10).collect())
    assert {r["feature"]: r["importance"] for r in classify.importances(model, ["x", "z"], df).collect()}["x"] > 0.8


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_survivors_fill_and_union(spark):
    rows = [(1, 1, "b", "", "x", False), (1, 2, "a", None, "y", True), (1, 3, "c", "long title", "x", False), (9, 9, "a", "own", "z", False)]
    df = spark.createDataFrame(rows, "group long, k long, source string, title string, tag string, core boolean")
    got = {r["group"]: r for r in linkage.merge_survivors(df, "k", ["source"], ["title"], ["tag"], "core", "source").collect()}
    assert (got[1]["k"], got[1]["title"], got[1]["tag"], got[1]["core"], got[1]["ids"], got[1]["n"]) == (2, "long title", ["x", "y"], True, {"a": 2, "b": 1, "c": 3}, 3)
    assert (got[9]["k"], got[9]["title"]) == (9, "own")


def test_titles(spark):
    df = spark.createDataFrame([("a city", "the story of a city"), ("", "x"), ("abcd", "abce")], "a string, b string")
    assert [r[0] for r in df.select(linkage.title_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.75]
    cover = spark.createDataFrame([("mining mining roads", "underminings of land"), ("a bc", "x")], "a string, b string")
    assert [r[0] for r in cover.select(linkage.token_coverage(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), None]


def test_points_in_a_concave_zone(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (3.0, 2.0), (0.0, 6.0)]
    zones = spark.createDataFrame([("z", ring)], "zone string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (3.0, 4.0), (5.5, 4.9), (3.0, 1.5), (7.0, 1.0)])], "p int, x double, y double")
    assert {r["p"] for r in joins.point_in_zone(points, zones, "x", "y", "zone", "ring").collect()} == {0, 2, 3}


def test_withheld_values_and_contracts(spark):
    text = '[{"V":"Valor","MN":"U","D1C":"c","D1N":"Local"},{"V":"1,5","MN":"kg","D1C":"7","D1N":"A"},{"V":"...","MN":"kg","D1C":"8","D1N":"B"}]'
    rows = records.api_table(spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "k int, t string"), "t", {"D1": "local"}, ["k"]).collect()
    assert [(r["k"], r["valor"], r["local_codigo"], r["local"], r["local_rotulo"]) for r in rows] == [(1, 1.5, "7", "A", "Local"), (1, None, "8", "B", "Local")]
    lines = records.json_lines(spark.createDataFrame([(1.0, 'a":2.0,b'), (float("nan"), None), (float("-inf"), ""), (1.23456, "")], "v double, s string"))
    assert [r[0] for r in lines.collect()] == ['{"v":1,"s":"a\\":2.0,b"}', '{"v":null,"s":null}', '{"v":null,"s":""}', '{"v":1.2346,"s":""}']
