"""Cutting a heavy key into chunks changes no result, and the plain results equal pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skywell.operators import features, fills, joins, layout as layout_module, sequences
from skywell.operators.layout import lay_out
from skywell.schema import Settings

START = dt.datetime(2024, 1, 1)
ORDER = ["Timestamp", "id"]


@pytest.fixture(scope="module")
def series():
    """Station 1 holds most rows, in bursts; station 2 few; station 3 one; station 4 is all null."""
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for station, n in ((1, 180), (2, 40), (3, 1), (4, 12)):
        t = np.cumsum(np.where(rng.random(n) < 0.1, 40000, rng.integers(0, 300, n)))
        for k in range(n):
            v = None if station == 4 or rng.random() < 0.45 else float(np.round(rng.normal(50, 20), 2))
            rows.append((i, station, START + dt.timedelta(seconds=int(t[k])), v, float(k % 7)))
            i += 1
    # A long null stretch longer than any chunk.
    rows = [(a, s, t, None if s == 1 and 60 <= a < 110 else v, k) for a, s, t, v, k in rows]
    return pd.DataFrame(rows, columns=["id", "Station", "Timestamp", "TEC", "Kp"])


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(r.id, r.Station, r.Timestamp.to_pydatetime(), None if r.TEC != r.TEC else r.TEC, r.Kp)
            for r in series.itertuples()]
    return spark.createDataFrame(
        rows, "id long, Station long, Timestamp timestamp, TEC double, Kp double").cache()


def rows_of(df, cols):
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(None if v is None or v != v else (round(v, 9) if isinstance(v, float) else v) for v in r))
    return sorted(out, key=repr)


SIZES = [7, 25]


@pytest.mark.parametrize("size", SIZES)
def test_positions(frame, size):
    plain, cut = lay_out(frame, ["Station"], ORDER), lay_out(frame, ["Station"], ORDER, 3, 2, ["TEC"], size)
    assert cut.chunked and not plain.chunked
    a = plain.finish(plain.rows, "pos")
    b = cut.finish(cut.rows, "pos")
    assert rows_of(a, ["id", "pos"]) == rows_of(b, ["id", "pos"])


@pytest.mark.parametrize("size", SIZES)
def test_chunks_stay_small(frame, size):
    cut = lay_out(frame, ["Station"], ORDER, 3, 3, ["TEC"], size)
    own = cut.rows.filter("_own").groupBy("Station", "_chunk").count().agg(F.max("count")).first()[0]
    assert own <= 40  # one bucket may overrun the size, never the whole key


def test_bursts_are_split(spark):
    """Most rows of the key fall into one second of a year, some at one instant."""
    ids = spark.range(400)
    at = (F.when(F.col("id") < 20, F.col("id") * 1_500_000_000_000).when(F.col("id") < 350, F.lit(7_000_000_000_000) + F.col("id") * 2500)
          .otherwise(F.lit(9_000_000_000_000)))
    df = ids.select(F.lit(1).alias("Station"), F.timestamp_micros(at).alias("Timestamp"), "id",
                    F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("TEC"))
    cut = lay_out(df, ["Station"], ORDER, 3, 3, ["TEC"], 20)
    sizes = sorted(r["count"] for r in cut.rows.filter("_own").groupBy("_chunk").count().collect())
    assert sizes[-1] <= 75 and sizes[-2] <= 45  # only rows of one instant stay together
    a = features.series_features(df, order=ORDER)
    b = features.series_features(df, order=ORDER, chunk_rows=20)
    assert rows_of(a, a.columns) == rows_of(b, b.columns)


@pytest.mark.parametrize("size", SIZES)
def test_series_features(frame, size):
    a = features.series_features(frame, order=ORDER)
    b = features.series_features(frame, order=ORDER, chunk_rows=size)
    assert rows_of(a, a.columns) == rows_of(b, a.columns)


def test_series_features_equal_pandas(frame, series):
    s = series.sort_values(["Station", "Timestamp", "id"])
    g = s.groupby("Station")["TEC"]
    want = pd.DataFrame({"id": s["id"], "lag2": g.shift(2), "diff": g.diff(),
                         "m6": g.rolling(6, min_periods=3).mean().reset_index(0, drop=True),
                         "s6": g.rolling(6, min_periods=3).std().reset_index(0, drop=True)}).set_index("id")
    got = features.series_features(frame, order=ORDER).select(
        "id", "TEC_lag2", "TEC_diff1", "TEC_roll_mean_6", "TEC_roll_std_6").toPandas().set_index("id")
    for a, b in zip(["lag2", "diff", "m6", "s6"], got.columns):
        np.testing.assert_allclose(want[a].sort_index().to_numpy(float), got[b].sort_index().to_numpy(float), atol=1e-7)


def test_gradient_equals_numpy(frame, series):
    got = features.series_features(frame, order=ORDER).select("id", "TEC_gradient").toPandas().set_index("id")["TEC_gradient"]
    for _, g in series.sort_values(["Timestamp", "id"]).groupby("Station"):
        known = g.dropna(subset=["TEC"])
        want = pd.Series(0.0, index=g["id"])
        if len(known) > 1:
            want.loc[known["id"]] = np.gradient(known["TEC"].to_numpy())
        np.testing.assert_allclose(got.loc[want.index], want, atol=1e-9)


@pytest.mark.parametrize("method", ["ffill", "bfill", "linear_both", "linear", "time"])
@pytest.mark.parametrize("size", SIZES)
def test_fills_cut(frame, method, size):
    a = fills.fill_gaps(frame, ["TEC"], method, 4, order=ORDER)
    b = fills.fill_gaps(frame, ["TEC"], method, 4, order=ORDER, chunk_rows=size)
    assert rows_of(a, a.columns) == rows_of(b, a.columns)


@pytest.mark.parametrize("method,limit", [("ffill", 3), ("bfill", 2), ("linear_both", 6), ("linear", 6)])
def test_fills_equal_pandas(frame, series, method, limit):
    def one(v):
        if method == "ffill":
            return v.ffill(limit=limit)
        if method == "bfill":
            return v.bfill(limit=limit)
        if method == "linear":
            return v.interpolate("linear", limit=limit)
        return v.interpolate("linear", limit=limit, limit_direction="both")

    s = series.sort_values(["Station", "Timestamp", "id"])
    want = s.groupby("Station", group_keys=False)["TEC"].apply(lambda v: one(v.astype(float)))
    want = pd.Series(want.to_numpy(), index=s["id"]).sort_index()
    got = fills.fill_gaps(frame, ["TEC"], method, limit, order=ORDER).select("id", "TEC").toPandas().set_index("id")["TEC"].sort_index()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_interpolation_shape_of_long_gaps(spark):
    """Leading run over the limit, inner gap of twice the limit and three, trailing run."""
    values = [None] * 8 + [1.0] + [None] * 15 + [17.0] + [None] * 8
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "Station long, Timestamp long, TEC double")
    df = df.withColumn("Timestamp", F.timestamp_seconds("Timestamp"))
    got = [r["TEC"] for r in fills.fill_gaps(df, ["TEC"], "linear_both", 6).orderBy("Timestamp").collect()]
    want = pd.Series(values, dtype=float).interpolate("linear", limit=6, limit_direction="both")
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), atol=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_sequences_cut(frame, size):
    for mode in ("reference", "full"):
        a = sequences.sequences(frame, ["TEC", "Kp"], "Kp", 8, 2, 0.3, order=ORDER, mode=mode)
        b = sequences.sequences(frame, ["TEC", "Kp"], "Kp", 8, 2, 0.3, order=ORDER, mode=mode, chunk_rows=size)
        cols = ["Station", "start", "start_ts", "end_ts", "completeness", "y"]
        assert rows_of(a, cols) == rows_of(b, cols)
        assert sorted(map(repr, a.select("x").collect())) == sorted(map(repr, b.select("x").collect()))


@pytest.mark.parametrize("n,reference,full", [(7, 0, 0), (8, 0, 1), (9, 1, 2)])
def test_window_counts_at_the_edge(spark, n, reference, full):
    df = spark.range(n).select(F.lit(1).alias("Station"), F.timestamp_seconds("id").alias("Timestamp"),
                               F.col("id").cast("double").alias("TEC"))
    assert sequences.sequences(df, ["TEC"], "TEC", 8).count() == reference
    assert sequences.sequences(df, ["TEC"], "TEC", 8, mode="full").count() == full
    ahead = sequences.sequences_ahead(df, ["TEC"], "TEC", 8, 1)
    assert ahead.count() == reference
    assert all(r["y"] == r["start"] + 8 for r in ahead.collect())


@pytest.mark.parametrize("size", SIZES)
def test_window_plan_cut(frame, size):
    s = Settings(min_completeness=0.4)
    a = sequences.window_plan(frame, ["TEC", "Kp"], "Kp", (2, 6), s, order=ORDER)
    b = sequences.window_plan(frame, ["TEC", "Kp"], "Kp", (2, 6), s, order=ORDER, chunk_rows=size)
    assert a.count() > 0 and rows_of(a, a.columns) == rows_of(b, a.columns)


@pytest.mark.parametrize("size", SIZES)
def test_modal_step_and_jumps_cut(frame, size):
    a, b = (fills.modal_step(frame, order=ORDER, chunk_rows=c) for c in (None, size))
    assert rows_of(a, a.columns) == rows_of(b, a.columns)
    a, b = (features.jumps(frame, "TEC", order=ORDER, chunk_rows=c) for c in (None, size))
    assert rows_of(a, a.columns) == rows_of(b, a.columns)


@pytest.mark.parametrize("size", [None, 9])
def test_asof_equals_pandas(spark, frame, series, size):
    rng = np.random.default_rng(5)
    times = sorted({START + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 900000, 150)})
    right = pd.DataFrame({"Timestamp": times, "idx": [float(i) for i in range(len(times))]})
    r = spark.createDataFrame([tuple(x) for x in zip(times, right["idx"].tolist())], "Timestamp timestamp, idx double")
    got = joins.asof_nearest(frame, r, "Timestamp", 900.0, chunk_rows=size)
    want = pd.merge_asof(series.sort_values("Timestamp"), right, on="Timestamp", direction="nearest",
                         tolerance=pd.Timedelta(seconds=900)).set_index("id")["idx"].sort_index()
    have = got.select("id", "idx").toPandas().set_index("id")["idx"].sort_index()
    np.testing.assert_array_equal(have.to_numpy(float), want.to_numpy(float))


def test_asof_ties_and_tolerance(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, t(50)), (2, t(1000)), (3, t(1001)), (4, t(5000))], "id long, Timestamp timestamp")
    right = spark.createDataFrame([(t(0), 10.0), (t(100), 20.0)], "Timestamp timestamp, v double")
    got = {r["id"]: r["v"] for r in joins.asof_nearest(left, right, "Timestamp", 900.0).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: None, 4: None}


def test_asof_equal_times_and_null_keys(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, "a", t(10)), (2, None, t(10)), (3, "b", t(10))], "id long, k string, Timestamp timestamp")
    right = spark.createDataFrame([("a", t(12), v) for v in (9.0, 5.0, 7.0)] + [(None, t(10), 1.0)],
                                  "k string, Timestamp timestamp, v double")
    for size in (None, 1):
        got = {r["id"]: r["v"] for r in joins.asof_nearest(left, right, "Timestamp", 900.0, ["k"], chunk_rows=size).collect()}
        assert got == {1: 5.0, 2: None, 3: None}


def test_asof_orders_distinct_times_only(spark, monkeypatch):
    """Copies of a time and the other columns of the left side never reach the windows."""
    t = lambda s: START + dt.timedelta(seconds=s)
    left = spark.range(3000).select("id", F.lit(t(50)).alias("Timestamp"), F.repeat(F.lit("x"), 100).alias("wide"))
    right = spark.createDataFrame([(t(0), 10.0), (t(60), 20.0)], "Timestamp timestamp, v double")
    seen = []
    monkeypatch.setattr(joins, "lay_out", lambda df, *a, **k: seen.append(df) or lay_out(df, *a, **k))
    out = joins.asof_nearest(left, right, "Timestamp", 900.0)
    assert out.where("v = 20.0 and length(wide) = 100").select("id").distinct().count() == 3000
    assert seen[0].count() == 3 and not {"id", "wide", "_l"} & set(seen[0].columns)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Short keys are dealt over as many tasks as their rows need, whatever the session would gather."""
    df = spark.range(4000).select("id", (F.col("id") % 200).alias("Station"), F.timestamp_seconds("id").alias("Timestamp"))
    monkeypatch.setattr(layout_module, "ROWS_A_TASK", 100)
    layout = lay_out(df, ["Station"], ORDER)
    out = layout.finish(layout.rows, "pos").withColumn("task", F.spark_partition_id())
    assert not layout.chunked and out.where("pos = (id - Station) / 200").count() == 4000
    assert out.groupBy("task").count().agg(F.max("count")).first()[0] <= 300


def test_no_lag_crosses_a_station(frame):
    out = features.series_features(frame, order=ORDER)
    layout = lay_out(out, ["Station"], ORDER)
    first = layout.finish(layout.rows, "pos").filter("pos = 0")
    assert first.filter("TEC_lag1 is not null or TEC_diff1 is not null").count() == 0 and first.count() == 4


def test_keep_first(frame):
    doubled = frame.unionByName(frame.withColumn("id", F.col("id") + 1000))
    out = fills.keep_first(doubled, ["Station", "Timestamp"], ["id"])
    assert out.filter("id >= 1000").count() == 0
