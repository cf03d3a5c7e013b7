"""Discovery operators, retrieval and forest against brute force on small fixtures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skywell.operators import discovery, forest, joins, outliers
from skywell.schema import Settings


def brute_line_lof(x, k):
    n = len(x)
    near = []
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (abs(x[i] - x[j]), j))
        near.append(order[:k])
    kd = [abs(x[i] - x[near[i][-1]]) for i in range(n)]
    lrd = [1 / (np.mean([max(kd[j], abs(x[i] - x[j])) for j in near[i]]) + 1e-10) for i in range(n)]
    return [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)]


@pytest.mark.parametrize("size", [15, 10_000])
def test_lof(spark, size):
    rng = np.random.default_rng(8)
    x = np.sort(np.concatenate([rng.normal(0, 1, 60), np.repeat(2.5, 12), [9.0, 9.1, 40.0]]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = discovery.lof_line(df, "x", k=7, chunk_rows=size).orderBy("id").toPandas()
    np.testing.assert_allclose(got["lof"], brute_line_lof(x, 7), rtol=1e-7)
    assert bool(got["is_outlier"].iloc[-1])


def brute_dbscan(points, eps, min_points):
    p = np.asarray(points, dtype=float)
    d = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1))
    close = (((p[:, None, :] - p[None, :, :]) ** 2).sum(-1)) <= eps * eps
    core = close.sum(1) >= min_points
    label = np.full(len(p), -1)
    current = 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], current
            while stack:
                a = stack.pop()
                for b in np.flatnonzero(close[a] & core & (label < 0)):
                    label[b] = current
                    stack.append(b)
            current += 1
    for i in np.flatnonzero(~core):
        near = [j for j in np.flatnonzero(close[i] & core)]
        if near:
            label[i] = label[min(near, key=lambda j: (d[i, j], tuple(p[j])))]
    return label


def same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all((x == -1) == (y == -1) for x, y in pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_plane(spark, seed):
    rng = np.random.default_rng(seed)
    ring = rng.uniform(0, 2 * np.pi, 120)
    pts = np.concatenate([
        rng.normal(0, 0.05, (150, 2)), np.column_stack([np.cos(ring), np.sin(ring)]), rng.uniform(-3, 3, (40, 2)),
        np.repeat([[2.0, 2.0]], 30, axis=0), [[2.3, 2.0], [2.29999999, 2.31]],
    ])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    got = discovery.dbscan_plane(df, "id", "x", "y", 0.3, 5).orderBy("id").toPandas()["cluster"].to_numpy()
    assert same_partition(brute_dbscan(pts, 0.3, 5).tolist(), got.tolist())


@pytest.mark.parametrize("size", [6, None])
def test_dbscan_line(spark, size):
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(0, 0.4, 60), rng.normal(5, 0.3, 30), rng.uniform(-9, 14, 30), np.repeat(9.0, 9)]), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = discovery.dbscan_line(df, "x", chunk_rows=size).orderBy("id").toPandas()["cluster"].to_numpy()
    want = brute_dbscan(np.column_stack([x, np.zeros(len(x))]), 0.5, 5)
    assert same_partition(want.tolist(), got.tolist())
    firsts = pd.Series(x).groupby(got).min()
    assert firsts[firsts.index >= 0].is_monotonic_increasing


@pytest.mark.parametrize("block", [7, 4096])
def test_topk_retrieval(spark, block):
    rng = np.random.default_rng(9)
    q, m = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    m[4] = m[9] = m[17]  # equal memories tie
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, q array<double>")
    ms = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "mid long, v array<double>")
    got = {r["qid"]: r for r in joins.topk_retrieve(qs, ms, 4, block_rows=block).collect()}
    s = q @ m.T / math.sqrt(5)
    for i in range(len(q)):
        keep = s[i] >= np.sort(s[i])[-4]
        w = np.where(keep, np.exp(s[i] - s[i].max()), 0)
        w /= w.sum()
        assert got[i]["n_kept"] == keep.sum()
        np.testing.assert_allclose(got[i]["value"], w @ m, atol=1e-9)


def test_memory_pool_and_labels(spark):
    a = spark.range(2).withColumn("v", F.lit(1.0))
    assert joins.memory_pool({"x": a, "y": a}).groupBy("bank").count().count() == 2


def test_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (3000, 3))
    x[:12] += 12
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(5000, None, 1.0, 1.0)],
                               "id long, a double, b double, c double")
    out = forest.isolation_forest(df, ["a", "b", "c"], ["id"], 0.01, trees=60).toPandas().set_index("id")
    assert out.loc[range(12), "is_outlier"].all()
    assert abs(out["is_outlier"].mean() - 0.01) <= 0.01 and math.isnan(out.loc[5000, "score"])
    again = forest.isolation_forest(df, ["a", "b", "c"], ["id"], 0.01, trees=60).toPandas().set_index("id")
    np.testing.assert_allclose(out["score"], again["score"])


def test_forest_skips_tiny_input(spark):
    df = spark.range(5).select("id", F.col("id").cast("double").alias("a"))
    out = outliers.forest_mask(df, ["a"], identity=("id",))
    assert out.filter("_mask_isolation_forest_a").count() == 0


def test_clip_follows_the_flag(spark):
    """Nothing flagged: values stay.  One flag: the whole column is clipped to its 1st and 99th percentile."""
    calm = spark.range(100).select("id", (F.col("id") / 10.0).alias("TEC"))
    s = Settings(outlier_methods=("iqr",))
    assert outliers.treat_outliers(calm, s, ("id",)).agg(F.max("TEC")).first()[0] == 9.9
    wild = calm.withColumn("TEC", F.when(F.col("id") == 99, 1000.0).otherwise(F.col("TEC")))
    x = np.append(np.arange(99) / 10.0, 1000.0)
    out = outliers.treat_outliers(wild, s, ("id",)).agg(F.min("TEC"), F.max("TEC")).first()
    np.testing.assert_allclose(out, np.quantile(x, [0.01, 0.99]))


def test_constant_column_is_never_an_outlier(spark):
    df = spark.range(50).select("id", F.lit(7.0).alias("TEC"))
    out = outliers.z_mask(outliers.iqr_mask(df, ["TEC"]), ["TEC"])
    assert out.filter("_mask_iqr_TEC or _mask_zscore_TEC").count() == 0


def test_mutual_information_prefers_the_cause(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 61 % 97).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 3)
    out = {r["feature"]: r["score"] for r in discovery.mutual_information(df, ["a", "b"], "y").collect()}
    assert out["a"] == 1.0 and out["b"] < 0.1


def test_pca_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) * [5, 2, 0.1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = discovery.pca_plane(df, "v").orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    for j in range(2):
        axis = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        np.testing.assert_allclose(got[:, j], c @ axis, atol=1e-6)


def test_bundle_computes_its_window_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, p double").withColumn("a", F.pandas_udf(counted, "double")("a"))
    found = discovery.discover(df, ["a", "b"], "p", "a", ["id"], discovery.history_of(df.limit(0).select("p"), "p"))
    before = seen.value
    assert before == 400
    for part in discovery.records(found).values():
        assert part.collect()
    assert seen.value == before


def test_path_sums_equal_walks(monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 7)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(60, 3)), 1)
    trees = [forest._grow(x[rng.choice(60, n)], rng, 6) for n in (1, 2, 40, 60)]
    nodes = pd.DataFrame([(t, *n) for t, tree in enumerate(trees) for n in tree],
                         columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    def walk(tree, row):
        at = {n[0]: n[1:] for n in tree}
        feature, cut, left, right, path = at[0]
        while feature >= 0:
            feature, cut, left, right, path = at[left if row[feature] < cut else right]
        return path

    x[3, 1] = np.nan
    want = [sum(walk(tree, row) for tree in trees) for row in x]
    np.testing.assert_allclose(forest._path_sums(x, forest._pack(nodes)), want, rtol=1e-12)
