"""Edge rows of the scalar rules, quality reports, stores, and monitors over several micro-batches."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from skywell.functions import rules
from skywell.operators import fills, metrics, quality
from skywell.session import scratch_path
from skywell.sources import stores, text
from skywell.streaming import monitors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_local_time_of_negative_longitude(spark):
    t = F.to_timestamp(F.lit("2024-01-01 01:30:00"))
    got = one(spark, a=rules.local_time(t, F.lit(-157.98)), b=rules.local_hour(t, F.lit(-157.98)), c=rules.local_hour(t, F.lit(None).cast("double")))
    assert got["a"] == pytest.approx((1.5 - 157.98 / 15) % 24) and got["b"] == 15 and got["c"] == 1


def test_season_codes(spark):
    for month, a, b in ((12, 0, 1), (2, 0, 1), (3, 1, 2), (8, 2, 3), (11, 3, 4)):
        got = one(spark, a=rules.season_from_zero(F.lit(month)), b=rules.season_from_one(F.lit(month)))
        assert tuple(got) == (a, b)


def test_unusual_kp_limits_of_the_flags(spark):
    """As written, a Kp on the 0-9 scale never raises the storm flag and always raises the quiet flag."""
    storm, quiet = rules.storm_flags(F.lit(9.0), F.lit(0.0))
    assert tuple(one(spark, s=storm, q=quiet)) == (0, 1)
    storm, quiet = rules.storm_flags(F.lit(9.0), F.lit(0.0), storm_kp=5.0, quiet_kp=3.0)
    assert tuple(one(spark, s=storm, q=quiet)) == (1, 0)


def test_overlapping_and_missing_storm_classes(spark):
    got = one(spark, a=metrics.storm_classes(F.lit(4.0), F.lit(-10.0)),
              b=metrics.storm_classes(F.lit(2.5), F.lit(None).cast("double")), c=metrics.storm_classes(F.lit(7.0), F.lit(-50.0)))
    assert list(got["a"]) == ["Quiet", "Moderate_Storm"] and list(got["b"]) == []
    assert list(got["c"]) == ["Moderate_Storm", "Strong_Storm"]


def test_year_day_hour_rejects_impossible_days(spark):
    got = one(spark, a=rules.year_day_hour(F.lit(2023), F.lit(366), F.lit(0)), b=rules.year_day_hour(F.lit(2024), F.lit(366), F.lit(5)))
    assert got["a"] is None and got["b"] == dt.datetime(2024, 12, 31, 5)


def test_non_finite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    got = df.select(rules.finite(F.col("x")).alias("x"), rules.is_infinite(F.col("x")).alias("i")).collect()
    assert sum(r["x"] is not None for r in got) == 1 and sum(r["i"] for r in got) == 2


def test_coerce_numeric_share(spark):
    df = spark.createDataFrame([(str(i), "a" if i % 2 else "1", None) for i in range(10)], "good string, bad string, none string")
    out = dict(rules.coerce_numeric(df).dtypes)
    assert out == {"good": "double", "bad": "string", "none": "string"}


def test_duplicate_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, 3.0), (2, 3.0)], "a long, b double")
    got = quality.duplicate_rows(df).first()
    assert (got["n_rows"], got["n_duplicates"]) == (5, 3) and got["fraction"] == pytest.approx(0.6)


def test_validation_of_an_empty_frame(spark):
    df = text.conform(spark.range(0).select(F.lit("x").alias("Station"), F.current_timestamp().alias("Timestamp")))
    report = quality.validate(df)
    assert quality.roll_up(report).first()["passed"]


def test_two_bounds_severities(spark):
    df = spark.range(100).select(F.when(F.col("id") < 5, 99.0).otherwise(3.0).alias("foF2"), F.when(F.col("id") < 50, -1.0).otherwise(3.0).alias("Kp"))
    rep = {r["affected_cols"][0]: r for r in quality.value_report(df).filter("check = 'PhysicalBounds'").collect()}
    assert rep["foF2"]["severity"] == "WARNING" and rep["Kp"]["severity"] == "ERROR" and rep["Kp"]["affected_rows"] == 50


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=1, max_size=30), st.sampled_from(["ffill", "bfill", "linear", "linear_both"]), st.integers(1, 4))
def test_fill_keeps_known_values(spark, values, method, limit):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "Station long, t long, x double").withColumn("t", F.timestamp_seconds("t"))
    got = [r["x"] for r in fills.fill_gaps(df, ["x"], method, limit, order=["t"]).orderBy("t").collect()]
    s = pd.Series(values, dtype=float)
    want = {"ffill": lambda: s.ffill(limit=limit), "bfill": lambda: s.bfill(limit=limit), "linear": lambda: s.interpolate(limit=limit),
            "linear_both": lambda: s.interpolate(limit=limit, limit_direction="both")}[method]()
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(float), rtol=1e-9, atol=1e-9)
    assert all(g == v for g, v in zip(got, values) if v is not None)


def test_hash_sees_copies_not_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 0.5, "b")], "a long, b double, c string")
    h = lambda d: stores.dataset_hash(d).first()["hash"]
    assert h(df) == h(df.orderBy(F.desc("a"))) and h(df) != h(df.unionByName(df))
    assert h(df) != h(df.withColumn("b", F.lit(0.5)))


def test_months_left_to_fetch(spark):
    root = scratch_path(spark, "land")
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 5), 1.0), ("A", dt.datetime(2024, 3, 1), 2.0)], "Station string, Timestamp timestamp, TEC double")
    stores.land(df, root)
    wanted = text.months(spark, "2024-01-15", "2024-04-02")
    left = stores.months_to_fetch(spark, root, wanted, "A").collect()
    assert sorted(r["month_of_year"] for r in left) == [2, 4]
    assert stores.months_to_fetch(spark, root, wanted, "A", force=True).count() == 4


def test_landing_folders_do_not_grow_with_stations(spark, tmp_path):
    root = str(tmp_path / "land")
    at = [dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 1)]
    rows = [(s, t, 1.0) for s in [*"ABCDEFGH", None] for t in [*at, None]]
    kind = "Station string, Timestamp timestamp, TEC double"
    stores.land(spark.createDataFrame(rows, kind), root)
    assert len([p for p in (tmp_path / "land").rglob("month=*") if p.is_dir()]) == 3
    stores.land(spark.createDataFrame([("B", at[0], 2.0), ("B", dt.datetime(2024, 1, 9), 3.0), (None, at[1], 4.0)], kind), root)
    want = [r for r in rows if r[:2] not in {("B", at[0]), (None, at[1])}] + [
        ("B", at[0], 2.0), ("B", dt.datetime(2024, 1, 9), 3.0), (None, at[1], 4.0)]
    got = stores.landed(spark, root).select("Station", "Timestamp", "TEC").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rows_of_prediction_files_are_numbered_where_they_are(spark, tmp_path):
    """Places come from the counts of the blocks; no row is ordered again."""
    for i in range(12):
        (tmp_path / "persistence_preds.csv").mkdir(exist_ok=True)
        lines = ["predicted_tec", *[str(100.0 * i + j) if j else "nan" for j in range(i)]]
        (tmp_path / "persistence_preds.csv" / f"part-{i:05d}.csv").write_text("\n".join(lines) + "\n")
    out = text.read_baselines(spark, str(tmp_path), ["Persistence"])
    want = [100.0 * i + j if j else None for i in range(12) for j in range(i)]
    assert [r["y_pred"] for r in out.orderBy("idx").collect()] == want
    assert sorted(r["idx"] for r in out.collect()) == list(range(len(want)))
    assert "row_number" not in out._jdf.queryExecution().toString()


def test_files_of_scaled_text(spark, tmp_path):
    (tmp_path / "EG931_2024.txt").write_text(
        "# Global survey\n#\n# Time                     CS foF2 QD TEC QD\n\n2024-01-01T00:00:00.000Z 80 5.5 // 12.1 //\n2024-01-01T00:15:00.000Z 90 --- __ 9\nbad 1\n")
    got = text.parse_scaled(text.read_scaled(spark, str(tmp_path))).orderBy("Timestamp").collect()
    assert [(r["Station"], r["foF2"], r["TEC"]) for r in got] == [("EG931", None, None), ("EG931", 5.5, 12.1), ("EG931", None, 9.0)]
    assert got[1]["Timestamp"] == dt.datetime(2024, 1, 1)


def test_observation_csv_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station,TEC,Timestamp,F10.7\nX,1.5,2024-01-01 00:00:00,120\nX,oops,never,\n")
    (tmp_path / "notes.txt").write_text("ignored")
    rows = text.read_observations(spark, str(tmp_path)).orderBy(F.col("TEC").asc_nulls_last()).collect()
    assert rows[0]["TEC"] == 1.5 and rows[0]["F10.7"] == 120.0 and rows[1]["TEC"] is None and rows[1]["Timestamp"] is None


def test_header_names(spark):
    names = ["Kp index", "R (Sunspot No.)", "Dst-index, nT", "ap_index, nT", "f10.7_index", "Year", "Decimal Day", "Hr", "other"]
    assert [text.canonical_name(n) for n in names] == ["Kp", "SSN", "Dst", "Ap", "F10.7", "YEAR", "DOY", "Hour", "other"]


@pytest.fixture(scope="module")
def two_files(spark, tmp_path_factory):
    """A stream source of three files, one station in time order across them."""
    root = str(tmp_path_factory.mktemp("stream"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "A" if i % 3 else "B", t0 + dt.timedelta(minutes=10 * i), float((i * 13) % 40)) for i in range(60)]
    schema = "id long, station string, ts timestamp, topside double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20:(part + 1) * 20], schema).coalesce(1).write.mode("append").parquet(root)
    full = spark.createDataFrame(rows, schema).withColumns({"net": F.col("topside") * 2, "density": F.col("topside") - 3})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root).withColumns(
        {"net": F.col("topside") * 2, "density": F.col("topside") - 3})
    return full, stream


def test_steps_carry_over_batches(spark, two_files):
    full, stream = two_files
    make = lambda root, sink: monitors.anomaly_batch(monitors.CarriedRows(root, 1, ["station"], ["ts", "id"]), sink, max_step=15.0)
    got = monitors.run_batches(stream, spark, make).select("id", "step", "massive_jump").toPandas().set_index("id")
    want = full.toPandas().sort_values("ts").groupby("station")["topside"].diff().abs()
    want.index = full.toPandas().sort_values("ts")["id"]
    np.testing.assert_allclose(got["step"].sort_index().to_numpy(float), want.sort_index().to_numpy(float))
    assert (got["massive_jump"].sort_index() == (want.sort_index() > 15)).all()


def test_sequences_carry_over_batches(spark, two_files):
    full, stream = two_files
    make = lambda root, sink: monitors.sequence_batch(monitors.CarriedRows(root, 4, ["station"], ["ts", "id"]), sink, ["topside"])
    got = monitors.run_batches(stream, spark, make)
    assert got.count() == (40 - 4) + (20 - 4)
    pdf = full.toPandas().sort_values("ts")
    for r in got.collect():
        part = pdf[(pdf["station"] == r["station"]) & (pdf["ts"] <= r["end_ts"])].tail(5)
        assert [c[0] for c in r["x"]] == part["topside"].tolist()


def test_windows_over_several_batches(spark, two_files):
    full, stream = two_files
    s = monitors.event_time(stream.withColumns({"kp": F.col("topside") / 5, "dst": -F.col("topside")}))
    got = monitors.run_available(monitors.storm_monitor(s, "1 hour", "1 hour"), spark)
    pdf = full.toPandas()
    want = (pdf.assign(h=pdf["ts"].dt.floor("h")).groupby("h")["topside"].max() / 5)
    want = want[[h + pd.Timedelta(hours=1) <= pdf["ts"].max() - pd.Timedelta(minutes=30) for h in want.index]]
    have = got.toPandas().set_index("start")["max_kp"].sort_index()
    np.testing.assert_allclose(have.to_numpy(), want.to_numpy())


def test_observed_counts_reach_the_progress(spark, two_files):
    full, stream = two_files
    seen = monitors.observe_stream(stream, "quality", {"high": F.col("topside") > 30})
    run = seen.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "noop")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = [p.observedMetrics["quality"] for p in run.recentProgress if "quality" in p.observedMetrics]
    assert sum(r["rows"] for r in seen) == 60 and sum(r["high"] for r in seen) == full.filter("topside > 30").count()
