"""Quantiles by shrinking brackets, against numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skywell.operators import ordering, stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def series():
    rng = np.random.default_rng(11)
    yield "normal", rng.normal(size=1500)
    yield "narrow", 1e6 + rng.random(1500) * 1e-6
    yield "two_heavy", np.repeat([1.0, 2.0], 600)
    yield "heavy_ends", np.concatenate([np.zeros(500), rng.random(40), np.ones(500)])
    yield "few", np.array([3.0, -1.0, 2.0])
    yield "one", np.array([5.0])
    yield "wide", np.concatenate([rng.normal(size=500) * 1e300, [np.inf, -np.inf], rng.normal(size=500) * 1e-300])
    yield "none", np.array([np.nan, np.nan])


def plain(x, p):
    x = np.sort(x[~np.isnan(x)])
    if not len(x):
        return None
    k = p * (len(x) - 1)
    lo, hi = x[int(np.floor(k))], x[int(np.ceil(k))]
    return lo + (hi - lo) * (k - np.floor(k)) if np.isfinite(hi - lo) else None


@pytest.mark.parametrize("bracket_rows", [40, 1_000_000])
def test_quantiles_equal_numpy(spark, monkeypatch, bracket_rows):
    monkeypatch.setattr(ordering, "BRACKET_ROWS", bracket_rows)
    frames = [pd.DataFrame({"g": g, "x": x, "y": -x}) for g, x in series()]
    df = spark.createDataFrame(pd.concat(frames)).withColumn("g", F.when(F.col("g") != "few", F.col("g"))).repartition(5)
    got = {r["g"] or "few": r for r in ordering.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, PROBS, ["g"]).collect()}
    assert len(got) == 8
    for g, x in series():
        for j, p in enumerate(PROBS):
            for name, v in (("x", x), ("y", -x)):
                want = plain(v, p)
                if want is not None:
                    assert got[g][f"{name}__{j}"] == pytest.approx(want, rel=1e-12), (g, name, p)
    assert got["none"]["x__3"] is None
    x = np.concatenate([x for g, x in series() if g != "wide"])
    row = ordering.quantiles(df.where("g <> 'wide' OR g IS NULL"), {"x": F.col("x")}, PROBS).first()
    for j, p in enumerate(PROBS):
        assert row[f"x__{j}"] == pytest.approx(plain(x, p), rel=1e-12)


def test_brackets_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 100)
    df = spark.range(50_000).select((F.col("id") * 0.5).alias("_v0"))
    b = ordering._brackets(df, 1, [0.25, 0.75], []).first()["_b"]
    assert len(b) == 2 and all((x["hi"] - x["lo"]) * 2 <= 100 and x["total"] == 50_000 for x in b)


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert ordering.quantiles(df, {"x": F.col("x")}, [0.5]).collect()[0]["x__0"] is None
    assert ordering.quantiles(df, {"x": F.col("x")}, [0.5], ["g"]).collect() == []


@pytest.mark.parametrize("t", [0.1, 1.0, 1.96, 3.0, 6.0])
def test_tails_of_many_pairs(t):
    normal = math.erfc(t / math.sqrt(2))
    assert stats.t_two_sided(t, 1e13) == normal
    assert stats.t_two_sided(t, 0.999e6) == pytest.approx(normal, rel=2e-3)
    assert stats.t_two_sided(t, 0.999e6) > normal
