"""Order statistics against NumPy and pandas: narrow ranges, heavy values, NaN, groups without values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skywell.operators import metrics, ordering, scaling, splitting, stats


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(11)
    x = np.concatenate([
        np.zeros(120), rng.normal(0, 1, 80), rng.normal(1e6, 1e-3, 60), -rng.pareto(0.4, 60), rng.integers(-3, 4, 80),
        [1e-12, -1e-12, 5e300, -5e300],
    ]).astype(float)
    return pd.DataFrame({"id": np.arange(len(x)), "g": np.arange(len(x)) % 3, "x": x})


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = [(int(r.id), int(r.g), float(r.x)) for r in values.itertuples()] + [(9999, 0, None)]
    return spark.createDataFrame(rows, "id long, g long, x double").cache()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.733, 0.99, 1.0]


def test_quantiles_binned(frame, values):
    got = ordering.quantiles(frame, {"x": F.col("x")}, PROBS, ["g"]).toPandas().set_index("g")
    for g, part in values.groupby("g"):
        want = part["x"].quantile(PROBS).to_numpy()
        np.testing.assert_allclose(got.loc[g].to_numpy(float), want, rtol=1e-12)


def test_quantiles_small(frame, values):
    got = ordering.quantiles(frame, {"x": F.col("x"), "y": F.col("x") * 2}, PROBS).first()
    np.testing.assert_allclose([got[f"x__{i}"] for i in range(len(PROBS))], values["x"].quantile(PROBS), rtol=1e-12)
    np.testing.assert_allclose([got[f"y__{i}"] for i in range(len(PROBS))], (values["x"] * 2).quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_binned(frame, values, by):
    got = ordering.with_average_rank(frame, "x", "rank", by).toPandas().set_index("id")["rank"]
    want = (values.groupby("g")["x"].rank() if by else values["x"].rank())
    np.testing.assert_allclose(got.loc[values["id"]].to_numpy(float), want.to_numpy())
    assert math.isnan(got.loc[9999])


def test_value_bins_are_monotone(frame):
    bins = frame.filter("x is not null").select("x", ordering.value_bin(F.col("x"), frame.schema["x"].dataType).alias("b"))
    rows = sorted((r["x"], r["b"]) for r in bins.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_split_boundaries_with_ties(spark):
    # A third of all rows share one time.
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") * 7 % 1000).alias("t"))
    out = splitting.split_ordered(df, ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert out["split"].tolist() == ["train"] * 210 + ["val"] * 45 + ["test"] * 45


def test_split_of_tiny_frame(spark):
    out = splitting.split_ordered(spark.range(1), ["id"]).collect()
    assert [r["split"] for r in out] == ["test"]


def test_metrics_equal_pandas(spark):
    rng = np.random.default_rng(2)
    y = np.round(rng.normal(50, 9, 400), 1)
    rows = [(int(i % 2), float(y[i]), None if i % 37 == 0 else float(np.round(y[i] + rng.normal(0, 5), 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "model long, y_true double, y_pred double")
    got = metrics.metrics(df, ["model"]).toPandas().set_index("model")
    for model, part in pd.DataFrame(rows, columns=["model", "y", "p"]).dropna().groupby("model"):
        ae = (part["p"] - part["y"]).abs()
        assert got.loc[model, "spearman"] == pytest.approx(part["y"].rank().corr(part["p"].rank()))
        assert got.loc[model, "median_ae"] == pytest.approx(ae.median())
        assert got.loc[model, "p95_ae"] == pytest.approx(ae.quantile(0.95))


def test_nan_is_missing_and_empty_groups_stay(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, -5.0), (0, 1.0), (0, 2.0), (0, nan), (0, nan), (1, None), (1, nan)], "g long, x double")
    counts = {r["x"]: r["_before"] for r in ordering.prefix_counts(df, "x").collect()}
    assert counts == {-5.0: 0, 1.0: 1, 2.0: 2}
    ranks = ordering.with_average_rank(df, "x", "r").collect()
    assert sorted(r["r"] for r in ranks if r["r"] is not None) == [1.0, 2.0, 3.0] and len(ranks) == 7
    q = {r["g"]: r["x__0"] for r in ordering.quantiles(df, {"x": F.col("x")}, [0.5], ["g"]).collect()}
    assert q == {0: 1.0, 1: None}
    cut = ordering.value_bin(F.col("x"), df.schema["x"].dataType)
    assert df.agg(F.max(cut)).first()[0] == ordering.LAST_BIN


@pytest.mark.parametrize("value", ["1.7e9D + id / 10D", "cast(least(id, 1000) as double)"])
def test_no_bin_holds_many_values(spark, value):
    df = spark.range(20_000).withColumn("x", F.expr(value))
    values = ordering._counted(df, [], "x", None)
    distinct = values.count()
    assert values.groupBy("_bin").count().agg(F.max("count")).first()[0] <= max(8, 4 * distinct / ordering.BINS)
    assert ordering.prefix_counts(df, "x").agg(F.max(F.col("_before") + F.col("_n"))).first()[0] == 20_000


def test_rows_without_a_time_come_last_and_count(spark):
    df = spark.createDataFrame([(i, None if i % 5 < 2 else float(i)) for i in range(10)], "id long, t double")
    got = {r["id"]: r["split"] for r in splitting.split_ordered(df, ["t", "id"]).collect()}
    order = [i for i in range(10) if i % 5 >= 2] + [i for i in range(10) if i % 5 < 2]
    assert [got[i] for i in order] == ["train"] * 7 + ["val"] + ["test"] * 2


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y_true double, y_pred double")
    m = metrics.metrics(df).first()
    assert m["n"] == 3 and m["mae"] == pytest.approx(2 / 3) and m["rmse"] == pytest.approx((2 / 3) ** 0.5)
    assert m["r2"] == pytest.approx(1 - 2 / (14 / 3), rel=1e-6) and m["median_ae"] == 1.0
    assert metrics.metrics(df.filter("y_pred > 99")).count() == 0


def test_wilcoxon_and_friedman_large_paths(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 1, -2, 3, 3, -3, 0, 5)], "d double")
    got = stats.wilcoxon(d).first()
    assert (got["n_nonzero"], got["w_statistic"]) == (7, 8.0)
    long = spark.createDataFrame([(i, m, float(v)) for i, row in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 2), (2, 1, 3)])
                                  for m, v in enumerate(row)], "idx long, model long, abs_error double")
    f = stats.friedman(long).first()
    ranks = np.array([[1, 2, 3], [1, 3, 2], [1, 2.5, 2.5], [2, 1, 3]])
    chi = (12 / (4 * 3 * 4) * (ranks.sum(0) ** 2).sum() - 3 * 4 * 4) / (1 - 6 / (4 * 3 * 8))
    assert f["chi_square"] == pytest.approx(chi)
    assert f["p_value"] == pytest.approx(math.exp(-chi / 2))


def test_exact_wilcoxon_equals_enumeration(spark):
    rng = np.random.default_rng(11)
    groups = {n: np.round(rng.normal(0.3, 1.0, n), 9) for n in (1, 2, 5, 11, 16)}
    rows = [(n, float(v)) for n, vs in groups.items() for v in vs]
    rows += [(50, 0.0), (50, float("nan")), (50, None), (51, 1.0), (51, -1.0), (51, 2.0)]
    rows += [(120, float(v)) for v in rng.normal(0, 1, 120)] + [(None, 4.0)]
    out = {r["g"]: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g long, d double"), ["g"]).collect()}
    assert set(out) == {1, 2, 5, 11, 16, 51, 120, None}
    for n, vs in groups.items():
        ranks = np.argsort(np.argsort(np.abs(vs))) + 1
        w = min(ranks[vs > 0].sum(), ranks[vs < 0].sum())
        signs = (np.arange(2 ** n)[:, None] >> np.arange(n)) & 1
        share = ((signs * np.arange(1, n + 1)).sum(1) <= w).mean()
        assert out[n]["w_exact"] and out[n]["w_statistic"] == w
        assert out[n]["w_p_value"] == pytest.approx(min(1.0, 2 * share), abs=1e-12)
    assert not out[51]["w_exact"] and not out[120]["w_exact"] and out[None]["w_p_value"] == 1.0
    assert out[120]["w_p_value"] == pytest.approx(stats.normal_two_sided(out[120]["w_z"]))
    none = stats.wilcoxon(spark.createDataFrame([], "d double")).first()
    assert none["n_nonzero"] is None and none["w_p_value"] is None


@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.0733880348), (1.0, 1, 0.5), (2.5705818, 5, 0.05), (0.5, 200, 0.6176283)])
def test_t_tail(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize("x,k", [(5.991464547, 2), (3.841458821, 1), (18.30703805, 10)])
def test_chi_tail(x, k):
    assert stats.gamma_tail(x / 2, k / 2) == pytest.approx(0.05, rel=1e-6)


@pytest.mark.parametrize("kind", ["robust", "standard", "minmax"])
def test_scalers_and_inverse(spark, kind):
    x = np.round(np.random.default_rng(4).normal(20, 6, 97), 2)
    df = spark.createDataFrame([(i, float(v), 3.0) for i, v in enumerate(x)], "id long, a double, c double")
    p = scaling.fit_scaler(df, ["a", "c"], kind)
    out = scaling.transform(df, p, ["a", "c"])
    a = out.orderBy("id").toPandas()["a"].to_numpy()
    want = {"robust": (x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)),
            "standard": (x - x.mean()) / x.std(), "minmax": (x - x.min()) / (x.max() - x.min())}[kind]
    np.testing.assert_allclose(a, want, atol=1e-9)
    assert {r["scale"] for r in p.filter("column = 'c'").collect()} == {1.0}
    back = scaling.inverse(out, p, ["a", "c"]).orderBy("id").toPandas()
    np.testing.assert_allclose(back["a"].to_numpy(), x, atol=1e-9)
    np.testing.assert_allclose(back["c"].to_numpy(), 3.0)
