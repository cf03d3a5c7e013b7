"""Composed jobs on the observation view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skywell.checks.base import HOURLY, PRED, hourly, observations, predictions, query, r, us, with_obs
from skywell.checks.scoring import PHYS, _metric_sql, _phys, _rounded
from skywell.operators import features
from skywell.plans import jobs
from skywell.schema import Settings, col
from skywell.session import scratch_path
from skywell.sources import stores

IDENTITY = ("Station", "Timestamp", "event_id")


def _slim(spark, sf):
    return observations(spark, sf).select("event_id", "Station", "Timestamp", F.col("tec_raw").alias("TEC"), "Kp", "Dst")


@query("canonical_merge", with_obs("""
  SELECT CAST(station AS VARCHAR) AS station, epoch_us(obs.ts) AS ts_us, round(latitude, 6) AS latitude, idx_kp AS kp,
    CAST(dayofyear(obs.ts) AS DOUBLE) AS doy,
    round(((hour(obs.ts) + minute(obs.ts) / 60.0 + longitude / 15.0) % 24.0 + 24.0) % 24.0, 6) AS local_time
  FROM obs LEFT JOIN hourly ON date_trunc('hour', obs.ts) = hourly.ts""", HOURLY))
def _(spark, sf):
    o = observations(spark, sf).withColumn("Station", F.col("Station").cast("string"))
    cat = o.groupBy("Station").agg(F.max("Latitude").alias("Latitude"), F.max("Longitude").alias("Longitude"))
    idx = hourly(spark, sf).select("Timestamp", F.col("idx_kp").alias("Kp"), F.col("idx_dst").alias("Dst"))
    out = jobs.merge_stations(o.select("Station", "Timestamp", "TEC"), idx, cat)
    return out.select(F.col("Station").alias("station"), us(F.col("Timestamp")).alias("ts_us"),
                      r(F.col("Latitude")).alias("latitude"), F.col("Kp").alias("kp"), F.col("DayOfYear").alias("doy"),
                      r(F.col("LocalTime")).alias("local_time"))


@query("synchronised_tables", with_obs("""
  SELECT epoch_us(ts) AS ts_us, round(a + 1e-9, 6) AS a, round(b + 1e-9, 6) AS b FROM (
    SELECT ts, coalesce(a1, CASE WHEN i - ai2 <= 2 THEN av2 END) AS a, coalesce(b1, CASE WHEN i - bi2 <= 2 THEN bv2 END) AS b FROM (
      SELECT ts, i, a1, b1, last_value(a1 IGNORE NULLS) OVER w AS av2, last_value(b1 IGNORE NULLS) OVER w AS bv2,
        last_value(CASE WHEN a1 IS NOT NULL THEN i END IGNORE NULLS) OVER w AS ai2,
        last_value(CASE WHEN b1 IS NOT NULL THEN i END IGNORE NULLS) OVER w AS bi2 FROM (
        SELECT ts, i, coalesce(a, CASE WHEN i - api <= 3 THEN coalesce(apv + (aqv - apv) * (epoch_us(ts) - apt) / (aqt - apt), apv) END) AS a1,
          coalesce(b, CASE WHEN i - bpi <= 3 THEN coalesce(bpv + (bqv - bpv) * (epoch_us(ts) - bpt) / (bqt - bpt), bpv) END) AS b1 FROM g)
      WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
  WHERE a IS NOT NULL AND b IS NOT NULL""",
    """
ta AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value) + 1e-9, 4) AS a FROM obs WHERE event_type IN ('click', 'view') GROUP BY 1),
tb AS (SELECT date_trunc('hour', ts) AS ts, round(avg(kp_raw) + 1e-9, 4) AS b FROM obs WHERE event_type <> 'click' GROUP BY 1),
j AS (SELECT ts, a, b, row_number() OVER (ORDER BY ts) AS i FROM ta FULL JOIN tb USING (ts)),
g AS (SELECT *, """ + ", ".join(
        f"""last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER p AS {c}pi, last_value({c} IGNORE NULLS) OVER p AS {c}pv,
        last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER p AS {c}pt,
        first_value({c} IGNORE NULLS) OVER f AS {c}qv, first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f AS {c}qt"""
        for c in "ab") + """ FROM j WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""))
def _(spark, sf):
    o = observations(spark, sf).withColumn("hour", F.date_trunc("hour", "Timestamp"))
    side = lambda types, c, out: o.filter(types).groupBy(
        F.col("hour").alias("Timestamp")).agg(F.round(F.avg(c) + 1e-9, 4).alias(out))
    out = jobs.synchronise(side("event_type IN ('click', 'view')", "value", "a"), side("event_type <> 'click'", "kp_raw", "b"), ["a", "b"])
    return out.select(us(F.col("Timestamp")).alias("ts_us"), r(F.col("a") + 1e-9).alias("a"), r(F.col("b") + 1e-9).alias("b"))


@query("preprocessing")
def _(spark, sf):
    rows, _ = jobs.preprocess(_slim(spark, sf), Settings(), IDENTITY)
    return rows.select("event_id", "split", r(F.col("TEC"), 4).alias("tec"), r(F.col("Kp"), 4).alias("kp"))


@query("feature_columns", with_obs("""
  SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST((month(ts) % 12) // 3 AS INT) AS season,
    round(sin(month(ts) * 2.0 * pi() / 12), 6) + 0.0 AS month_sin, lag(value) OVER s AS lag1 FROM obs
  WINDOW s AS (PARTITION BY station ORDER BY ts, event_id)"""))
def _(spark, sf):
    out = features.feature_pipeline(observations(spark, sf), name="value", order=["Timestamp", "event_id"])
    return out.select("event_id", F.col("Hour").alias("hour"), F.col("Season").alias("season"),
                      r(F.col("Month_sin")).alias("month_sin"), F.col("value_lag1").alias("lag1"))


@query("preparation", with_obs("""
  SELECT split, 2 AS window_h, CAST(sum(greatest(c - 8, 0)) AS BIGINT) AS n_windows FROM (
    SELECT station, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'val'
           ELSE 'test' END AS split, count(*) AS c
    FROM (SELECT station, row_number() OVER (ORDER BY ts, station, event_id) - 1 AS i,
                 CAST(count(*) OVER () AS DOUBLE) AS n FROM obs) GROUP BY ALL)
  GROUP BY split HAVING sum(greatest(c - 8, 0)) > 0"""))
def _(spark, sf):
    # The SQL has the smallest size; `preparation_windows` has the rows of every size.
    out = jobs.prepare(_slim(spark, sf), "TEC", ["TEC", "Kp"], Settings(), IDENTITY)
    return out["windows"].where("window_h = 2").groupBy("split", "window_h").agg(F.count("*").alias("n_windows"))


@query("preparation_windows")
def _(spark, sf):
    rows = [jobs.prepare(_slim(spark, sf), target, ["TEC", "Kp", "Dst"], Settings(), IDENTITY)["windows"].select(
        F.lit(target).alias("target"), "split", F.col("Station").alias("station"), "window_h", "start",
        us(F.col("start_ts")).alias("start_us"), us(F.col("end_ts")).alias("end_us"), r(F.col("completeness")).alias("completeness"),
        r(F.col("y"), 4).alias("y")) for target in ("TEC", "Dst")]
    return reduce(DataFrame.unionByName, rows)


def _build(spark, sf, root):
    o = observations(spark, sf)
    giro = o.select("Station", "Timestamp", "event_id", "TEC", "foF2", "Longitude")
    omni = hourly(spark, sf).select("Timestamp", F.col("idx_ap").alias("Kp"), F.col("idx_dst").alias("Dst"))
    return jobs.build_dataset(giro, omni, "2024-01-01", "2024-01-31", ["TEC", "foF2", "Kp", "Dst"], ["foF2", "TEC"],
                              root, Settings(), tie=("event_id",))


@query("versioned_build", with_obs("""
  WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT station, ts FROM obs
             WHERE ts <= TIMESTAMP '2024-01-31 23:59:59'))
  SELECT 'train' AS split, CAST(floor(n * 0.7) AS BIGINT) AS n_rows FROM c
  UNION ALL SELECT 'val', CAST(floor(n * 0.85::DOUBLE) - floor(n * 0.7) AS BIGINT) FROM c
  UNION ALL SELECT 'test', CAST(n - floor(n * 0.85::DOUBLE) AS BIGINT) FROM c"""))
def _(spark, sf):
    # The SQL counts the rows; `versioned_build_sequences` has what is written of every target.
    out = _build(spark, sf, scratch_path(spark, "build"))
    return out["rows"].groupBy("split").agg(F.count("*").alias("n_rows"))


@query("versioned_build_sequences")
def _(spark, sf):
    root = scratch_path(spark, "build")
    version = _build(spark, sf, root)["version"]
    return spark.read.parquet(f"{root}/{version}/sequences").select(
        "target", "split", F.col("Station").alias("station"), "start", us(F.col("start_ts")).alias("start_us"),
        us(F.col("end_ts")).alias("end_us"), "x", "y")


def _short_build(spark, sf, root):
    """A build with windows short enough for the stations of the given tables, over two columns without gaps."""
    giro = observations(spark, sf).select("Station", "Timestamp", "event_id", F.col("value").alias("TEC"),
                                          (100 + 10 * F.sqrt("value")).alias("hmF2"), "Longitude")
    omni = hourly(spark, sf).select("Timestamp", F.col("idx_ap").alias("Kp"), F.col("idx_dst").alias("Dst"))
    return jobs.build_dataset(giro, omni, "2024-01-01", "2024-01-31", ["TEC", "hmF2"], ["TEC", "hmF2"], root,
                              Settings(build_window=6), tie=("event_id",))


SHORT = """
c AS (SELECT station, ts, arg_min(value, event_id) AS tec FROM obs WHERE ts <= TIMESTAMP '2024-01-31 23:59:59' GROUP BY station, ts),
p AS (SELECT *, 100 + 10 * sqrt(tec) AS hmf2, row_number() OVER (ORDER BY ts, station) - 1 AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM c),
t AS (SELECT *, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p),
f AS (SELECT avg(tec) AS m1, stddev_pop(tec) AS s1, avg(hmf2) AS m2, stddev_pop(hmf2) AS s2 FROM t WHERE split = 'train'),
z AS (SELECT split, station, ts, (tec - m1) / s1 AS tec, (hmf2 - m2) / s2 AS hmf2 FROM t, f),
w AS (SELECT split, station, row_number() OVER s - 1 AS start, tec AS first_tec, lead(hmf2, 5) OVER s AS last_hmf2,
        lead(tec, 6) OVER s AS y_tec, lead(hmf2, 6) OVER s AS y_hmf2 FROM z WINDOW s AS (PARTITION BY split, station ORDER BY ts))
"""


@query("versioned_build_windows", with_obs("""
  SELECT target, split, station, start, round(first_tec + 1e-9, 5) AS first_tec, round(last_hmf2 + 1e-9, 5) AS last_hmf2,
         round(CASE target WHEN 'TEC' THEN y_tec ELSE y_hmf2 END + 1e-9, 5) AS y
  FROM w, (VALUES ('TEC'), ('hmF2')) v(target) WHERE y_tec IS NOT NULL""", SHORT))
def _(spark, sf):
    """The windows of both targets in the latest committed version; a later build that was lost before its commit is not it."""
    root = scratch_path(spark, "build")
    version = _short_build(spark, sf, root)["version"]
    stores.write_version(spark.read.parquet(f"{root}/{version}/data"), root, commit=False)
    found = spark.read.parquet(f"{root}/{stores.latest_version(spark, root)}/sequences")
    return found.select("target", "split", F.col("Station").alias("station"), F.col("start").cast("long").alias("start"),
                        r(F.col("x")[0][0] + 1e-9, 5).alias("first_tec"), r(F.col("x")[5][1] + 1e-9, 5).alias("last_hmf2"),
                        r(F.col("y") + 1e-9, 5).alias("y"))


@query("versioned_build_manifest", with_obs("""
  SELECT 'data' AS part, count(*) AS n_rows, true AS intact FROM t
  UNION ALL SELECT 'sequences', 2 * count(y_tec), true FROM w
  UNION ALL SELECT unnest(['feature_scaler', 'target_scaler', 'feeds']), 2, true""", SHORT))
def _(spark, sf):
    """Counts and hashes of every part of a version, taken anew from its folder."""
    root = scratch_path(spark, "build")
    return stores.check_version(spark, root, _short_build(spark, sf, root)["version"])


@query("evaluation_run", with_obs(_metric_sql("model", "SELECT * FROM pred"), PRED))
def _(spark, sf):
    out = jobs.evaluate(predictions(spark, sf), _phys(spark, sf), order=("ts", "event_id"))
    return _rounded(out["metrics"], ["model"])


@query("evaluation_score", with_obs("""
  WITH ph AS (SELECT 0.3 * avg((topside >= 0)::INT) * 100 + 0.3 * avg((density >= 0)::INT) * 100
      + 0.25 * avg((abs(net - (topside + bottomside)) / (abs(topside + bottomside) + 1e-8) <= 0.15)::INT) * 100
      + 0.15 * avg(CASE WHEN prev IS NOT NULL THEN (abs(topside - prev) <= abs(prev) * 0.5 + 5)::INT END) * 100 AS p
    FROM phys),
  m AS (SELECT model, 1 - sum(e2) / (var_pop(y_true) * count(*) + 1e-8) AS r2,
      (sqrt(avg(e2) FILTER (WHERE split = 'test')) - sqrt(avg(e2) FILTER (WHERE split = 'train')))
        / (sqrt(avg(e2) FILTER (WHERE split = 'train')) + 1e-8) * 100 AS gap,
      sqrt(avg(e2) FILTER (WHERE kp >= 6 OR dst <= -80))
        / (sqrt(avg(e2) FILTER (WHERE kp <= 2 OR dst > -30)) + 1e-8) AS deg
    FROM (SELECT *, (y_pred - y_true) * (y_pred - y_true) AS e2 FROM pred WHERE y_pred IS NOT NULL) GROUP BY model)
  SELECT model, round(greatest(0, least(100, greatest(0, r2 * 40) + p / 100 * 30 + greatest(0, 15 - gap / 20 * 15)
    + greatest(0, 10 - (deg - 1) / 2 * 10) + 5)), 4) AS scientific_score FROM m, ph""", PRED, PHYS))
def _(spark, sf):
    out = jobs.evaluate(predictions(spark, sf), _phys(spark, sf), order=("ts", "event_id"))
    return out["score"].select("model", r(F.col("scientific_score"), 4).alias("scientific_score"))


@query("benchmark_run", with_obs("""
  SELECT model, round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 6) AS rmse FROM pred WHERE y_pred IS NOT NULL GROUP BY model""",
    PRED))
def _(spark, sf):
    return jobs.benchmark(predictions(spark, sf), "rolling")["comparison"].select("model", r(F.col("rmse")).alias("rmse"))
