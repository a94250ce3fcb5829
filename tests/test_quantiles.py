"""Quantiles by refining ranges against sorted values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import analysis
from surveyloom.operators import quantiles as Q


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    out = [("ties", float(pick.choice([1, 2, 2, 50])), 1.0) for _ in range(500)]
    out += [(None, pick.gauss(0, 1) * 10 ** pick.randint(-8, 8), pick.choice([0.25, 1.0, 3.0])) for _ in range(1500)]
    out += [("wide", pick.choice([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, 1.0]), 1.0) for _ in range(60)]
    out += [("one", 7.0, 2.0), ("two", 1.0, 1.0), ("two", 4.0, 1.0), ("none", None, 1.0), ("one", float("nan"), 9.0)]
    return out, spark.createDataFrame(out, "g string, y double, w double")


def test_interpolated(rows):
    data, df = rows
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r["g"]: r for r in Q.quantiles(df, ["g"], "y", shares).collect()}
    assert set(got) == {"ties", None, "wide", "one", "two"}
    for g in ("ties", None, "one", "two"):
        own = [y for k, y, _ in data if k == g and y is not None and y == y]
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(own, q), rel=1e-12, abs=1e-300)
    assert got["wide"]["a"] == -1.7e308 and got["wide"]["e"] == 1.7e308


def test_weighted(rows):
    data, df = rows
    got = {r["g"]: r for r in Q.weighted_quantiles(df, ["g"], "w", "y", {"m": 0.5, "p": 0.9, "z": 0.0}).collect()}
    for g in {k for k, *_ in data} - {"none"}:
        own = sorted((y, w) for k, y, w in data if k == g and y is not None and y == y)
        total = sum(w for _, w in own)
        for name, q in (("m", 0.5), ("p", 0.9), ("z", 0.0)):
            c = 0.0
            for y, w in own:
                c += w
                if c >= q * total - 1e-9 * total:
                    break
            assert got[g][name] == y


def test_no_cell_and_no_rows(rows):
    data, df = rows
    known = [y for _, y, _ in data if y is not None and y == y]
    assert Q.quantiles(df, [], "y", {"m": 0.5}).first()["m"] == pytest.approx(np.median(known))
    assert Q.quantiles(df.where("false"), ["g"], "y", {"m": 0.5}).count() == 0
    assert Q.quantiles(df.where("g = 'none'"), [], "y", {"m": 0.5}).count() == 0
    assert Q.weighted_quantiles(df.withColumn("w", F.lit(0.0)), ["g"], "w", "y", {"m": 0.5}).count() == 0
    tiers = analysis.exposure_tiers(df.where("g = 'none'"), "y").collect()
    assert [r["tier"] for r in tiers] == ["nenhuma"]
